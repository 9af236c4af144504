"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans follow fixed patterns, leftmost and non-overlapping within a kind; a match that fails its
check is dropped without a retry. Around digits and at-signs, written out or not, the text is cut into
tokens, and every run of tokens, MOST_CHARS characters at most, that could be an entity is a candidate segment.
Whole-segment features (digit count, grouping, separators, checksum, octets, cue words, borders) give
its score for each kind; a dynamic program over segment ends chooses boundaries and kinds together.
Every candidate holds a digit or an at-sign, so it lies, with the CONTEXT tokens before it that its
features look at, in the region around that; text outside has no candidates and scores 0, so the
program over a region is exact for the document. Segments that meet a base span are not added.

No labels of personal data exist, so the field is trained by its conditional likelihood on seeded,
made-up sentences with plain and disguised entities and look-alikes (dates, versions, prices, ids, numbers that
fail a card's checksum, times and places behind "at").

Null and empty texts have no spans, an empty table gives an empty one; offsets are code points, ends exclusive. Repeated rows and null or
equal doc_ids each give a row; columns other than doc_id and text are ignored. Every pass is linear in
the text: patterns start at signs or run borders, segments are bounded.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import slices, tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run without a dot after it can't begin a match at any of its digits, so starts are run borders.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# Candidate segments.

TRIGGER = re.compile(r"[0-9@]|(?<![^\W\d_])(?:[aA][tT]|[aA][rR]{2}[oO][bB][aA])(?![^\W\d_])")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\n")
LETTERS = re.compile(r"[^\W\d_]{2}")
MOST_CHARS, CONTEXT = 72, 4
AT_WORDS, DOT_WORDS = frozenset({"at", "arroba"}), frozenset({"dot", "punto", "punkt"})
#: Words that announce a kind, in the corpus's languages.
CUES = (
    frozenset({"mail", "email", "contact", "correo", "courriel", "write"}),
    frozenset({"ip", "host", "server", "address", "adresse", "node"}),
    frozenset({"card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"}),
    frozenset({"tel", "phone", "call", "telefon", "téléphone", "teléfono", "mobile", "fax"}),
)
#: Words that stand before or behind "at" in plain sentences, and are no names of people or hosts.
PLAIN = frozenset(
    "a all am an and are arrive arrived arrives as back be been best but call came come dinner eat end ended ends first found had has he held her here him his home i in is it kept last later least leave leaves left live lived lives look looked looks lunch me meet meets met most my night noon of on once one open opens or our out sat school see she sit stand start started starts stay stayed stop stopped that the their them there they this time up us was we went were will with work worked works you your".split()
)
NUMERIC = frozenset("+-(). /:")
#: Signs within an address, and what blanks may stand beside in one.
SIGNS = frozenset("@._%+-[](){}")
JOINTS = AT_WORDS | DOT_WORDS | frozenset("@[](){}")
Segment = tuple[int, int, tuple[int, ...]]  # first token, end token, kinds


def within(text: str, at: int) -> bool:
    """True if a token goes on across this place."""
    a, b = text[at - 1 : at], text[at : at + 1]
    if "0" <= a <= "9" or "0" <= b <= "9":
        return "0" <= a <= "9" and "0" <= b <= "9"
    return bool(LETTERS.fullmatch(a + b))


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges with token borders, which hold all candidates and the tokens their features look at."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        done = out[-1][1] if out else 0
        hi = min(len(text), m.end() + MOST_CHARS)
        if hi <= done:
            continue
        lo, passed = max(done, m.start() - MOST_CHARS), 0
        while lo > done and within(text, lo):
            lo -= 1
        while lo > done and passed < CONTEXT:
            lo -= 1
            passed += not text[lo].isspace() and not within(text, lo) or text[lo] == "\n"
        while hi < len(text) and within(text, hi):
            hi += 1
        if out and lo <= done:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def segments(text: str, tokens: list[re.Match]) -> list[Segment]:
    """Every run of tokens that could be an entity, with the kinds it could have."""
    out = []
    words = [t[0] for t in tokens]
    lower = [w.lower() for w in words]
    numeric = [w[0] in "0123456789" or w in NUMERIC for w in words]
    for i, first in enumerate(words):
        if first == "\n" or not (first[0].isalnum() or first in "+("):
            continue
        only_numbers, ats, dots, digits, spaces = True, 0, 0, 0, 0
        for j in range(i, len(words)):
            word = words[j]
            gap = tokens[j].start() - tokens[j - 1].end() if j > i else 0
            spaces += gap > 0
            if word == "\n" or gap > 1 or tokens[j].end() - tokens[i].start() > MOST_CHARS:
                break
            if not only_numbers and not (word[0].isalnum() or word in SIGNS):
                break
            if gap and not only_numbers and not any(w in JOINTS for w in (lower[j - 1], lower[j])):
                break
            only_numbers &= numeric[j]
            ats += word == "@" or (lower[j] in AT_WORDS and j > i)
            dots += ats > 0 and (word == "." or lower[j] in DOT_WORDS)
            digits += len(word) if word[0] in "0123456789" else 0
            if ats > 1 or (not only_numbers and (digits > 12 or not first[0].isalnum())):
                break
            if only_numbers and digits >= 4 and word[0] in "0123456789":
                out.append((i, j + 1, (1, 2, 3)))
            elif ats == 1 and dots and spaces <= 8 and word.isalpha() and len(word) >= 2 and lower[j] not in DOT_WORDS and (words[j - 1] in ".])}" or lower[j - 1] in DOT_WORDS):
                out.append((i, j + 1, (0,)))
    return out


FEATURES = 50


def features(text: str, tokens: list[re.Match], i: int, j: int) -> np.ndarray:
    """Whole-segment features; the place of each is fixed by the order below."""
    begin, end = tokens[i].start(), tokens[j - 1].end()
    span = text[begin:end]
    before, after = text[begin - 1 : begin], text[end : end + 1]
    groups = [t[0] for t in tokens[i:j] if t[0][0] in "0123456789"]
    sizes = [len(g) for g in groups]
    n = sum(sizes)
    lower = [t[0].lower() for t in tokens[i:j]]
    near = {t[0].lower() for t in tokens[max(0, i - CONTEXT) : i]}
    quad = len(groups) == 4 and span.count(".") == 3 and len(span) == n + 3
    at = next((k for k, w in enumerate(lower) if w == "@" or (k and w in AT_WORDS)), -1)
    tail = lower[at + 1 :]
    marked = any(w in "[]({})" for w in lower) and at > 0
    values = [
        1,
        before.isalnum(),
        before != "" and before in ".-@+/:_$€#",
        after.isalnum(),
        after != "" and after in "@/:_-%€$",
        after == "." and text[end + 1 : end + 2].isdigit(),
        after == "." and text[end + 1 : end + 2].isalpha(),
        bool(re.match(r"\s?[\[({]?(?:dot|punto|punkt)\b", text[end : end + 9])),
        *[bool(near & cues) for cues in CUES],
        n <= 6,
        7 <= n <= 9,
        10 <= n <= 12,
        13 <= n <= 15,
        n == 16,
        17 <= n <= 19,
        n > 19,
        span[0] == "+",
        "(" in span and span.count("(") == span.count(")"),
        span.count("(") != span.count(")"),
        "-" in span,
        " " in span,
        "/" in span or ":" in span,
        "." in span,
        len(groups) == 1,
        sizes == [4, 4, 4, 4],
        sizes[-3:] == [3, 3, 4],
        len(sizes) > 5 or 1 in sizes[1:],
        quad,
        quad and all(int(g[:9]) <= 255 for g in groups),
        13 <= n <= 19 and luhn("".join(groups)),
        bool(re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}|\d{4}\s?-\s?\d{4}", span)),
        "@" in span,
        at > 0 and "@" not in span and marked,
        at > 0 and "@" not in span and not marked,
        any(w in DOT_WORDS for w in tail),
        bool(tail) and tail[-1].isalpha() and 2 <= len(tail[-1]) <= 6,
        span.count(" ") > 4,
        at == 1 or (marked and at == 2),
        ".." in span or "--" in span or "  " in span,
        at > 0 and lower[at] == "arroba",
        at > 0 and "@" not in span and any(w in PLAIN for w in lower[:at]),
        at > 0 and "@" not in span and any(w in PLAIN for w in tail),
        13 <= n <= 19 and not luhn("".join(groups)),
        bool(re.fullmatch(r"[0-9][\x20.-]", text[max(0, begin - 2) : begin])) and span[0] != "+",
        bool(re.match(r"[\x20.-][0-9]", text[end : end + 2])),
        at > 0 and i > 0 and lower[0].isalpha() and tokens[i - 1][0].lower() in DOT_WORDS,
    ]
    return np.array(values + [0] * (FEATURES - len(values)), np.float64)


# The field.


def scored(text: str, tokens: list[re.Match], weights: np.ndarray) -> tuple[list[Segment], np.ndarray, np.ndarray]:
    found = segments(text, tokens)
    x = np.array([features(text, tokens, i, j) for i, j, _ in found]).reshape(len(found), FEATURES)
    return found, x, x @ weights


def decode(n_tokens: int, found: list[Segment], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, end token, kind); outside tokens score 0."""
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for s, (i, j, kinds) in enumerate(found):
        kind = max(kinds, key=lambda k: scores[s, k])
        if scores[s, kind] > 0:
            ending.setdefault(j, []).append((i, kind, float(scores[s, kind])))
    best, back = [0.0] * (n_tokens + 1), [(-1, -1)] * (n_tokens + 1)
    for j in range(1, n_tokens + 1):
        best[j] = best[j - 1]
        for i, kind, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n_tokens
    while j:
        i, kind = back[j]
        if i < 0:
            j -= 1
        else:
            out.append((i, j, kind))
            j = i
    return out[::-1]


def log_add(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def marginals(n_tokens: int, found: list[Segment], scores: np.ndarray) -> np.ndarray:
    """Probability of each segment with each kind, over all segmentations."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j, _) in enumerate(found):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    forward, backward = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)
    for j in range(1, n_tokens + 1):
        forward[j] = log_add([forward[j - 1], *[forward[found[s][0]] + scores[s, k] for s in by_end.get(j, ()) for k in found[s][2]]])
    for i in range(n_tokens - 1, -1, -1):
        backward[i] = log_add([backward[i + 1], *[backward[found[s][1]] + scores[s, k] for s in by_start.get(i, ()) for k in found[s][2]]])
    out = np.zeros((len(found), len(KINDS)))
    for s, (i, j, kinds) in enumerate(found):
        for k in kinds:
            out[s, k] = np.exp(forward[i] + scores[s, k] + backward[j] - forward[n_tokens])
    return out


def made_up(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Sentences with marked entities, plain and disguised, and look-alikes without a mark."""
    draw = random.Random(seed)
    plain = sorted(PLAIN)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: "".join(draw.choice(("th", "er", "on", "an", "re", "ti", "es", "or")) for _ in range(draw.randint(1, 4)))

    def card() -> str:
        stem = "4" + digits(14)
        number = next(stem + d for d in "0123456789" if luhn(stem + d))
        return draw.choice(("", " ", "-", ".")).join(number[k : k + 4] for k in range(0, 16, 4))

    def no_card() -> str:
        """A number of a card's length that fails the checksum, in one of many groupings."""
        n = draw.choice((13, 14, 15, 16, 16, 16, 17, 18, 19))
        stem = digits(n - 1)
        number = stem + draw.choice([d for d in "0123456789" if not luhn(stem + d)])
        size = draw.choice((4, 4, 4, n))
        return draw.choice(("", " ", "-")).join(number[k : k + size] for k in range(0, n, size))

    def email() -> str:
        at, dot = draw.choice((("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" arroba ", " punto "), (" arroba ", "."), (" [at] ", "."), (" (at) ", ".")))
        host = dot.join([word() for _ in range(draw.randint(1, 2))] + [draw.choice(("com", "org", "net", "de", "es", "example"))])
        local = draw.choice((word(), word() + digits(2), word() + dot + word() if dot != "." else word() + "." + word()))
        return local + at + host

    def phone() -> str:
        a, b, c = str(draw.randint(200, 999)), digits(3), digits(4)
        return draw.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {digits(3)} {digits(7)}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"))

    def ip() -> str:
        return ".".join(str(draw.randint(0, 255)) for _ in range(4))

    def other() -> str:
        return draw.choice(
            (
                f"{digits(4)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}",
                f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 9)}",
                f"${draw.randint(1, 999)}.{digits(2)}",
                f"{draw.randint(10, 23)}:{draw.randint(10, 59)}",
                digits(draw.choice((4, 5, 6, 8, 9, 20, 24))),
                f"{draw.randint(300, 999)}.{digits(3)}.{draw.randint(300, 999)}.{digits(3)}",
                f"{draw.randint(1900, 1999)} - {draw.randint(2000, 2030)}",
                "at " + word() + " dot " + word(),
                "at " + word() + "." + draw.choice((" ", "")) + word(),
                f"{draw.randint(1, 9)} / {draw.randint(10, 99)} {digits(4)}",
                f"id{digits(10)}",
                f"{digits(3)}-{digits(2)}",
                "@" + word(),
                draw.choice(plain) + " at " + draw.choice(plain) + draw.choice((" dot ", ". ", " dot com ")) + word(),
                draw.choice(plain) + " at " + word() + " dot " + draw.choice(("com", word())),
                word() + " at " + draw.choice(plain) + " dot " + draw.choice(("com", word())),
                no_card(),
                no_card(),
            )
        )

    kinds = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(draw.randint(1, 2)):
            text += " " + " ".join(word() for _ in range(draw.randint(0, 4)))
            kind = draw.randint(0, 5)
            if kind > 3:
                text += " " + other()
            else:
                if draw.random() < 0.3:
                    text += " " + draw.choice(sorted(CUES[kind]))
                entity = kinds[kind]()
                text += " "
                spans.append((len(text), kind, len(text) + len(entity)))
                text += entity
            text += draw.choice((" ", ".", ",", " " + word(), ". " + word()))
        out.append((text, spans))
    return out


def measured(seed: int, sentences: int, weights: np.ndarray) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind's spans, base and added, on made-up sentences."""
    right, said, held = ([0] * len(KINDS) for _ in range(3))
    for text, spans in made_up(seed, sentences):
        found = all_spans(text, weights)[1]
        for count, part in ((right, set(found) & {(a, k, b) for a, k, b in spans}), (said, found), (held, spans)):
            for _, k, _ in part:
                count[k] += 1
    return {kind: (right[k] / max(1, said[k]), right[k] / max(1, held[k])) for k, kind in enumerate(KINDS)}


@functools.lru_cache(maxsize=4)
def trained(seed: int = 7, sentences: int = 900, epochs: int = 14, rate: float = 0.5, decay: float = 0.0005) -> np.ndarray:
    """Weights (features by kinds) by stochastic gradient ascent of the conditional likelihood."""
    weights = np.zeros((FEATURES, len(KINDS)))
    scale = np.full_like(weights, 1e-6)
    examples = []
    for text, spans in made_up(seed, sentences):
        tokens = list(TOKEN.finditer(text))
        found, x, _ = scored(text, tokens, weights)
        truth = np.zeros((len(found), len(KINDS)))
        for s, (i, j, kinds) in enumerate(found):
            span = tokens[i].start(), tokens[j - 1].end()
            for a, k, b in spans:
                if (a, b) == span and k in kinds:
                    truth[s, k] = 1
        if found:
            examples.append((len(tokens), found, x, truth))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            n, found, x, truth = examples[e]
            gradient = x.T @ (truth - marginals(n, found, x @ weights)) - decay * weights
            scale += gradient**2
            weights += rate * gradient / np.sqrt(scale)
    return weights


def field_spans(text: str, weights: np.ndarray) -> list[Span]:
    out = []
    for lo, hi in regions(text):
        tokens = list(TOKEN.finditer(text, lo, hi))
        found, _, scores = scored(text, tokens, weights)
        if found:
            out += [(tokens[i].start(), k, tokens[j - 1].end()) for i, j, k in decode(len(tokens), found, scores)]
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's spans that meet none of them."""
    base = base_spans(text)
    added, k = [], 0
    if TRIGGER.search(text):
        marked = merged(base)
        for a, kind, b in sorted(field_spans(text, weights)):
            while k < len(marked) and marked[k][1] <= a:
                k += 1
            if k == len(marked) or marked[k][0] >= b:
                added.append((a, kind, b))
    return base, sorted(base + added)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the spans."""
    out: list[list[int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans: all."""
    weights = trained()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            found = [all_spans(t, weights) for t in frame["text"]]
            out = {"doc_id": frame["doc_id"].astype("Int64")}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [joined(spans) for _, spans in found]
            yield pd.DataFrame(out)

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with each span of text replaced by its kind in angle brackets, and n_chars with it."""
    weights = trained()
    schema = docs.select(*keep).schema

    def mask(text: str) -> str:
        spans = all_spans(text, weights)[1]
        if not spans:
            return text
        kinds = {}
        for a, k, _ in reversed(spans):
            kinds[a] = k
        parts, done = [], 0
        for a, b in merged(spans):
            parts += [text[done:a], f"<{KINDS[kinds[a]].upper()}>"]
            done = b
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(mask, na_action="ignore")

    run = tidy(run)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    out = docs.select(*keep).withColumn("text", masked("text"))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*keep)
