"""Main text of web pages by equivalence-class template deduction.

A page is read into tokens: its tags, each in the role given by the path of open elements above it,
and its text blocks. A token's occurrence vector over the host's pages (how often on each) is summed
up as one 64-bit value, the sum over pages of the count times a hash of the page: tokens have equal
sums when they have equal vectors. Being a sum, it is gathered for all pages of a host without the
pages ever meeting, however many they are.

Tokens with one vector form an equivalence class. The class of the tokens met once on every page is
the template's root; a class is valid if its tokens nest, that is if the parents of its outermost
elements lie in one valid class, which it then fills a slot of. Paths of valid classes are the
template's slots; blocks whose text is on nearly all of the different pages that have their slot are
the template's own words, in articles too. A slot's gain is its text outside links and template words,
weighed by what tags and names say of it (WEIGHTS). If the slot of most gain lies in an article or main
element, main text is what articles hold, without slots that are mostly links; else it is what lies in
that slot. A page that holds nothing there (another layout) is judged by its own slots' gains in the same way.
Tags, roles and hidden attributes drop what they hold for good, telling names only if something else has more gain.

Null pages and pages without text give an empty text, an empty table an empty one. Elements whose path is longer than
2,000 characters count as part of what holds them; nothing of a long page is left out. Null or odd URLs share the host "". Repeated
rows and null or equal page_ids each give a row; template words need DISTINCT different pages. Other
columns are ignored. Unclosed and misplaced tags are tolerated; comments, scripts and the like are
skipped to their end, or to the end of the page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import mix64, slices
from strandwise.session import written

# HTML's element kinds and names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hr address details summary center".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social footer comment comments disqus respond replies reply legal copyright pagination pager search skip toolbar".split()
)
PAGE_HEADS = frozenset("header masthead topbar".split())
#: Names that tell outside articles only: inside, they may be what the article is about.
OUTSIDE = frozenset("legal copyright search skip".split())
#: Name parts that say where an element is, not what it holds: beside others, a telling name tells nothing ("share-price").
PLACES = frozenset(
    "area body list lists box block wrap wrapper container inner outer left right top bottom main content section item items link links bar slot unit site page post entry col column columns row group panel field form thread title text primary secondary global local mini full wide small large fixed sticky mobile desktop with no has is the js s x".split()
)
MAIN_ELEMENTS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
#: Words of a name, and short numbers; longer ones are ids that differ from page to page.
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|(?<![0-9])[0-9]{1,2}(?![0-9])")
#: Share of a host's pages on which a tag's role must be to belong to the template.
SUPPORT = 0.5
#: Share of pages, and number of different ones, on which a block must be to be the template's own words.
WORDS_SUPPORT, DISTINCT = 0.9, 8
#: Bytes of templates that every task may hold; more are joined to the pages instead.
MOST_TEMPLATES = 16_000_000

#: Marks of what an element holds; the elements above add theirs.
KEEP, MAIN, NAMED, DROP = 0, 1, 2, 4
#: How much a character of a slot counts, by its highest mark.
WEIGHTS = {KEEP: 1.0, MAIN: 8.0, NAMED: 1 / 32}
#: Elements that hold a page's text: only names without any other part tell against them, and none against the first two.
HOLDERS = ("html", "body", "article", "main")


def judged(name: str, attributes: str, inside_main: bool) -> tuple[str, int]:
    """An element's name in paths, and its own mark: page furniture by kind or by name, or a main element."""
    kind = DROP if name in FURNITURE else KEEP
    if name == "header" and not inside_main:
        kind = DROP
    label = name
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names = {w.lower() for w in NAME_PART.findall(value)}
                if key == "class":
                    label += "." + "-".join(sorted(names))
                telling = names & (NAMES - OUTSIDE if inside_main else NAMES | PAGE_HEADS)
                others = {n for n in names - telling if not n.isdigit()} - (PLACES if name not in HOLDERS else set())
                if telling and not others and kind == KEEP and name not in HOLDERS[:2]:
                    kind = NAMED
            elif key == "role":
                if value.lower() in ROLES:
                    kind = DROP
                elif value.lower() == "main" and kind == KEEP:
                    kind = MAIN
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                kind = DROP
            elif key == "itemprop" and value == "articleBody" and kind == KEEP:
                kind = MAIN
    if name in MAIN_ELEMENTS and kind == KEEP:
        kind = MAIN
    return label, kind


class Page:
    """A page's tag roles with their counts, and its blocks as (path, kind, text, characters in links)."""

    def __init__(self, source: str):
        self.roles: dict[str, int] = defaultdict(int)
        self.blocks: list[tuple[str, int, str, int]] = []
        stack: list[tuple[str, str, int]] = [("", "", KEEP)]  # name, path, kind
        text: list[str] = []
        in_link, linked = 0, 0
        at, n = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                if words:
                    path = next(p for name, p, _ in reversed(stack) if name not in INLINE)
                    kind = next(k for k in (DROP, NAMED, MAIN, KEEP) if stack[-1][2] & k == k)
                    self.blocks.append((path, kind, words, min(linked, len(words))))
                text.clear()
            linked = 0

        while at < n:
            m = TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                piece = source[at:end]
                text.append(piece)
                if in_link:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name not in INLINE:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        in_link -= sum(e[0] == "a" for e in stack[k:])
                        if name not in INLINE:
                            self.roles["/" + stack[k][1]] += 1
                        del stack[k:]
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in RAW:
                if name not in INLINE:
                    flush()
                if not m[3].rstrip().endswith("/") or name in ("script", "style"):
                    close = re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|(?=<body\b)", re.I).search(source, at)
                    if close:
                        at = close.end()
                    elif name not in ("head", "template"):
                        at = n
                self.roles[stack[-1][1] + ">" + name] += 1
                continue
            if name not in INLINE:
                flush()
            if name in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    in_link -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                elif stack[k][0] in SCOPE:
                    break
            parent = stack[-1]
            label, kind = judged(name, m[3], bool(parent[2] & MAIN))
            kind |= parent[2]
            path = parent[1] if name in INLINE else parent[1] + ">" + label
            if len(path) > 2000:
                path = parent[1]
            stack.append((name, path, kind))
            in_link += name == "a"
            if name not in INLINE:
                self.roles[path] += 1
        flush()


def container(path: str) -> str:
    """The path without its innermost text elements."""
    parts = path.split(">")
    while len(parts) > 1 and parts[-1].split(".")[0] in LEAF:
        parts.pop()
    return ">".join(parts)


def slot_of(path: str, kind: int) -> str:
    return f"@{kind}{container(path)}"


def short_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def text_key(path: str, kind: int, text: str) -> str:
    """A block's token: hashes of its slot and of its place and text."""
    return "#" + short_hash(slot_of(path, kind)) + short_hash(f"{path}\n{text}")


def gain(kind: int, chars: int, links: int) -> float:
    """What a slot's text outside links counts; what is mostly links counts below 0."""
    free = chars - 2 * links
    return free * WEIGHTS[kind] if free > 0 else float(free)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """For each host and token: pages it is on, its count, its vector's sum, and the text and link characters of its slot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], list[int]] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "token", "pages", "n", "vector", "chars", "links", "bits"])
            for name in ("vector", "bits"):
                frame[name] = frame[name].map(lambda v: (v + 2**63) % 2**64 - 2**63).astype("int64")
            return frame

        for frame in slices(frames, text="html"):
            for host, source in zip(frame["host"], frame["html"]):
                page = Page(source)
                mark = int(mix64(np.array([int.from_bytes(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], np.uint64))[0])
                tokens = {role: [n, 0, 0] for role, n in page.roles.items()}
                tokens["*"] = [1, 0, 0]
                for path, kind, text, links in page.blocks:
                    if kind == DROP:
                        continue
                    for token in (slot_of(path, kind), text_key(path, kind, text)):
                        row = tokens.setdefault(token, [0, 0, 0])
                        row[0], row[1], row[2] = row[0] + 1, row[1] + len(text), row[2] + links
                for token, (n, chars, links) in tokens.items():
                    row = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n
                    row[2] = (row[2] + n * mark) % 2**64
                    row[3] += chars
                    row[4] += links
                    row[5] |= 1 << (mark % 64)
                if len(sums) > 100_000:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    schema = "host string, token string, pages long, n long, vector long, chars long, links long, bits long"
    rows = pages.select("host", "html").mapInPandas(run, schema)
    total = F.sum(F.col("vector").cast("decimal(38,0)"))
    return rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), total.alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.bit_or("bits").alias("bits"))


def template(tokens: list[tuple[str, int, int, int, int, int, int]]) -> dict:
    """A host's template from its tokens (token, pages, n, vector, chars, links, marks), those of whole or half support."""
    pages = next(t[1] for t in tokens if t[0] == "*")
    root = next(t[3] for t in tokens if t[0] == "*") % 2**64
    classes: dict[int, list[str]] = defaultdict(list)
    for token, on, _, vector, *_ in tokens:
        if token[0] in ">/" and on >= SUPPORT * pages:
            classes[vector % 2**64].append(token.lstrip("/"))
    valid, slots = {root}, {"": 0}
    known = {path: 0 for path in classes.get(root, ())}
    ordered = sorted((min(p.count(">") for p in paths), vector, paths) for vector, paths in classes.items() if vector != root)
    for _, vector, paths in ordered:
        own = set(paths)
        outer = {p.rpartition(">")[0] for p in own} - own
        parents = {known.get(p, 0 if not p else -1) for p in outer}
        if len(parents) == 1 and -1 not in parents:  # nested in one slot of one class
            valid.add(vector)
            for p in own:
                known.setdefault(p, len(valid))
    slots |= known
    held = {t[0]: t for t in tokens if t[0][0] == "@" and t[0][2:] in slots}
    by_hash = {short_hash(slot): slot for slot in held}
    words, fixed = [], defaultdict(lambda: [0, 0])
    for token, on, n, _, chars, links, marks in tokens:  # marks: of 64, so that copies of a page count once
        slot = by_hash.get(token[1:19]) if token[0] == "#" else None
        if slot and held[slot][6] >= DISTINCT and n == on >= WORDS_SUPPORT * held[slot][1] and marks >= WORDS_SUPPORT * held[slot][6]:
            words.append(token)
            fixed[slot][0] += chars
            fixed[slot][1] += links
    gains = {slot: gain(int(slot[1]), t[4] - fixed[slot][0], t[5] - fixed[slot][1]) for slot, t in held.items()}
    richest = max(gains, key=lambda slot: (gains[slot], slot), default="")
    return {"richest": richest if gains.get(richest, 0) > 0 else "", "links": sorted(slot for slot in gains if gains[slot] < 0), "words": sorted(words)}


def templates(pages: DataFrame) -> DataFrame:
    """host and template (JSON) of each host; a host's tokens of less than half support never leave the aggregate."""
    found = written(occurrences(pages), "token-vectors")
    whole = found.where("token = '*'").select(F.col("host").alias("own"), F.col("pages").alias("all_pages"))
    kept = found.join(F.broadcast(whole) if whole.count() < 10_000 else whole, found["host"] == F.col("own"))
    kept = kept.where((F.col("pages") >= F.lit(SUPPORT) * F.col("all_pages")) | (F.col("token").startswith("#") & (F.col("pages") >= F.lit(WORDS_SUPPORT * SUPPORT) * F.col("all_pages"))))
    row = F.struct("token", "pages", "n", F.col("vector").cast("string").alias("vector"), "chars", "links", F.bit_count("bits").alias("marks"))

    @F.pandas_udf("string")
    def deduced(lists: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(template([(t["token"], t["pages"], t["n"], int(t["vector"]), t["chars"], t["links"], t["marks"]) for t in rows])) for rows in lists])

    return written(kept.groupBy("host").agg(F.collect_list(row).alias("rows")).select("host", deduced("rows").alias("template")), "templates")


def main_text(source: str, known: dict) -> str:
    """The page's main blocks, joined by newlines."""
    blocks = [b for b in Page(source).blocks if b[1] != DROP]
    # A page of nothing but template words is a copy of its host's pages.
    blocks = [b for b in blocks if text_key(b[0], b[1], b[2]) not in known["words"]] or blocks if known["words"] else blocks
    chosen = held_by(known["richest"], known["links"], blocks) if known["richest"] else []
    if not chosen and blocks:
        mass: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for path, kind, text, links in blocks:
            row = mass[slot_of(path, kind)]
            row[0], row[1] = row[0] + len(text), row[1] + links
        gains = {slot: gain(int(slot[1]), *row) for slot, row in mass.items()}
        chosen = held_by(max(gains, key=lambda slot: (gains[slot], slot)), (), blocks)
    return "\n".join(b[2] for b in chosen)


def held_by(richest: str, links: Container[str], blocks: list[tuple[str, int, str, int]]) -> list[tuple[str, int, str, int]]:
    """The blocks of articles, but for slots of links, if the richest slot lies in one, else the blocks in that slot."""
    kind, path = int(richest[1]), richest[2:]
    if kind == MAIN:
        return [b for b in blocks if b[1] == MAIN and slot_of(b[0], MAIN) not in links]
    return [b for b in blocks if b[1] <= max(kind, MAIN) and inside(b[0], path)]


def inside(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + ">")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    deduced = templates(pages)
    size = deduced.agg(F.coalesce(F.sum(F.length("template") + F.length("host")), F.lit(0)).alias("s")).first().s
    schema = "page_id long, url string, text string, n_chars long"
    shared = {r.host: r.template for r in deduced.collect()} if size <= MOST_TEMPLATES else None
    if shared is None:
        pages = pages.join(deduced, "host")
    columns = ["page_id", "url", "html", "host", *([] if shared is not None else ["template"])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, dict] = {}
        for frame in slices(frames, text="html"):
            texts = []
            for i, (host, source) in enumerate(zip(frame["host"], frame["html"])):
                if host not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear()
                    loaded[host] = json.loads(shared[host] if shared is not None else frame["template"].iat[i])
                    loaded[host]["links"], loaded[host]["words"] = set(loaded[host]["links"]), set(loaded[host]["words"])
                texts.append(main_text(source, loaded[host]))
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(*columns).mapInPandas(run, schema)
