"""Phrase collocations from generalised suffix automata over shards of a corpus.

Texts, A-Z lower-cased, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`.
Everything is counted per language.

1. Words are counted. Of pairs of neighbours whose words both reach the least count, hashes are counted;
   the hashes that reach it become a bit table. A longer phrase can reach the count only if all its pairs do,
   so texts fall into runs: stretches of words whose neighbouring pairs are all marked. The table only
   prunes: it has no false negatives, and what it lets through is counted exactly.
2. Each task puts its runs into shards of one language and builds one generalised suffix automaton a
   shard, word by word. A state stands for the phrases that end at the same places; suffix links carry the
   counts of places down. A state's phrases are the suffixes of its longest one that are longer than the
   longest of its link, so the phrases of two to `depth` words come from (length, link, end) alone.
3. The shards' counts are added up per phrase.
4. Subsumption: a phrase inside a longer one of the same count belongs to the same places. Counts never
   grow with a phrase, so one step shows it: each phrase is compared with what is left of it without its last
   word and without its first (the suffix that its link leads towards).
5. Each cut of a phrase looks its two parts' counts up; the lowest score stays.

The shards hold a bounded number of words, the bit table a bounded number of bits; a corpus too rich for the
table is pruned less, with the same result. The phrases kept per language are found per salt first.

Null texts count as empty, a null lang as `und`. Repeated rows, null or equal doc_ids count each. Texts of any
length are read in full; a run longer than a shard is one shard of its own. An empty table gives an empty
one. Columns other than lang and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import RangeHash, mix64, partitions, slices, utf8
from strandwise.session import written

#: Marks that end a piece, and the tab, as line feeds and blanks.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Words of a shard's runs.
SHARD = 100_000
#: Distinct words or pair hashes that a task holds before it hands them on.
HELD = 500_000
#: Least and most bits of the table of pair or word hashes.
TABLE_BITS = 16, 26
ODD = np.uint64(0x9E6C63D0876A9A47)


class SuffixAutomaton:
    """The generalised suffix automaton of runs of symbols, with how often each state's phrases end somewhere."""

    def __init__(self) -> None:
        self.length, self.link, self.end, self.count = [0], [-1], [-1], [0]
        self.arcs: list[dict[int, int]] = [{}]

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A state for those phrases of q that the state p reaches."""
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.end.append(self.end[q])
        self.count.append(0)
        self.arcs.append(self.arcs[q].copy())
        self.link[q] = copy
        while p >= 0 and self.arcs[p].get(symbol) == q:
            self.arcs[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, run: list[int], begin: int) -> None:
        """Adds one run, whose first symbol is at the place begin of the shard."""
        length, link, end, count, arcs = self.length, self.link, self.end, self.count, self.arcs
        last = 0
        for place, symbol in enumerate(run, begin):
            p, q = last, arcs[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
            else:
                last = len(length)
                length.append(length[p] + 1)
                end.append(place)
                count.append(0)
                arcs.append({})
                while p >= 0 and symbol not in arcs[p]:
                    arcs[p][symbol] = last
                    p = link[p]
                if p < 0:
                    link.append(0)
                else:
                    q = arcs[p][symbol]
                    link.append(0)  # a place for it: a split below appends
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
            count[last] += 1

    def phrases(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places of first words, counts) of all distinct phrases of 2 <= k <= depth words."""
        length, link = np.array(self.length), np.array(self.link)
        count = self.count
        for state in np.argsort(-length, kind="stable")[:-1].tolist():
            count[self.link[state]] += count[state]
        ends, counts = np.array(self.end), np.array(count)
        above = np.where(link >= 0, length[link], 0)
        for k in range(2, depth + 1):
            here = np.flatnonzero((length >= k) & (above < k))
            yield k, ends[here] - k + 1, counts[here]


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(utf8(lang), digest_size=8).digest(), "little"))


class Words:
    """The words of many texts: where they lie, the pieces that they belong to, and hashes of (lang, word)."""

    def __init__(self, langs: list[str], texts: list[str]):
        rows = [utf8(t) for t in texts]
        self.data = (b"\n".join(rows) + b"\n").lower().translate(PLAIN)
        buffer = np.frombuffer(self.data, np.uint8)
        ends = buffer == 10
        edges = np.flatnonzero(np.diff(np.concatenate([[True], ends | (buffer == 32), [True]]).astype(np.int8)))
        self.first, self.last = edges[0::2], edges[1::2]
        self.piece = np.cumsum(ends)[self.first]
        starts = np.cumsum([0] + [len(r) + 1 for r in rows])
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        seeds = {lang: lang_seed(lang) for lang in set(langs)}
        seed = np.array([seeds[lang] for lang in langs], np.uint64)
        self.hash = mix64(RangeHash(buffer).of(self.first, self.last) ^ seed[self.text])

    def pairs(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are followed in their piece by another, both marked in words; and each pair's hash."""
        good = marked(words, size, self.hash)
        joined = np.zeros(len(good), bool)
        joined[:-1] = good[:-1] & good[1:] & (self.piece[:-1] == self.piece[1:])
        after = np.roll(self.hash, -1)
        return joined, mix64(self.hash * ODD + after)


def marked(table: np.ndarray, size: int, hashes: np.ndarray) -> np.ndarray:
    places = hashes & np.uint64((1 << size) - 1)
    return (table[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A table with the bits of all hashes (column hash) set, in 64-bit words, and the number of bits as a power of two."""
    size = min(TABLE_BITS[1], max(TABLE_BITS[0], (8 * hashes.count()).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit((1 << size) - 1))
    cells = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS INT)))").alias("bits"))
    rows = cells.toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table, size


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word) and f."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, words in counts.items():
                words.pop(b"", None)
                if words:
                    yield pd.DataFrame({"lang": lang, "phrase": [w.decode("utf-8", "surrogatepass") for w in words], "f": list(words.values())})

        for frame in slices(frames, most=1_000_000):
            for lang, texts in frame.groupby("lang", sort=False)["text"]:
                data = b"\n".join(map(utf8, texts)).lower().translate(PLAIN).replace(b"\n", b" ")
                counts.setdefault(lang, Counter()).update(data.split(b" "))
            if sum(map(len, counts.values())) > HELD:
                yield from rows()
                counts = {}
        yield from rows()

    return docs.mapInPandas(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_hashes(words: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": Words(frame["lang"].tolist(), frame["phrase"].tolist()).hash.view(np.int64)})

    return words.select("lang", "phrase").mapInPandas(run, "hash long")


def pair_hashes(docs: DataFrame, words: tuple[np.ndarray, int], least: int) -> DataFrame:
    """The hashes (lang, two words) that occur at least so often, among pairs of marked words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        table, size = words

        def rows() -> pd.DataFrame:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"hash": hashes.view(np.int64), "n": counts})

        for frame in slices(frames, most=1_000_000):
            found = Words(frame["lang"].tolist(), frame["text"].tolist())
            joined, hashes = found.pairs(table, size)
            held.append(hashes[joined])
            if sum(map(len, held)) > 8 * HELD:
                yield rows()
                held = []
        if held:
            yield rows()

    counted = docs.mapInPandas(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("hash")


def phrase_counts(docs: DataFrame, words: tuple[np.ndarray, int], pairs: tuple[np.ndarray, int], depth: int) -> DataFrame:
    """lang, k, phrase and f of the phrases of two to depth words in runs of marked pairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[str, list[list[bytes]]] = {}
        sizes: Counter = Counter()

        def rows(lang: str) -> Iterator[pd.DataFrame]:
            automaton, names, seen = SuffixAutomaton(), {}, []
            for words_of_run in shards.pop(lang):
                automaton.add([names.setdefault(w, len(names)) for w in words_of_run], len(seen))
                seen += words_of_run
            del sizes[lang]
            for k, begins, counts in automaton.phrases(depth):
                texts = [b" ".join(seen[a : a + k]).decode("utf-8", "surrogatepass") for a in begins.tolist()]
                for a in range(0, len(texts), 100_000):
                    yield pd.DataFrame({"lang": lang, "k": np.int32(k), "phrase": texts[a : a + 100_000], "f": counts[a : a + 100_000]})

        for frame in slices(frames, most=1_000_000):
            langs = frame["lang"].tolist()
            found = Words(langs, frame["text"].tolist())
            joined, hashes = found.pairs(*words)
            joined[joined] = marked(*pairs, hashes[joined])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
            starts, stops = found.first.tolist(), found.last.tolist()
            for a, b, text in zip(edges[0::2].tolist(), edges[1::2].tolist(), found.text[edges[0::2]].tolist()):
                lang = langs[text]
                shards.setdefault(lang, []).append([found.data[starts[i] : stops[i]] for i in range(a, b + 1)])
                sizes[lang] += b + 1 - a
                if sizes[lang] >= SHARD:
                    yield from rows(lang)
            while sizes.total() > 2 * SHARD:  # many languages: the largest goes first
                yield from rows(sizes.most_common(1)[0][0])
        for lang in list(shards):
            yield from rows(lang)

    found = docs.mapInPandas(run, "lang string, k int, phrase string, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def not_subsumed(phrases: DataFrame) -> DataFrame:
    """The phrases (lang, k, phrase, f) that lie in no longer one of the same count."""
    shorter = F.expr("explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k)))")
    inside = phrases.where("k > 2").select("lang", shorter.alias("phrase"), "f").distinct()
    return phrases.join(inside, ["lang", "phrase", "f"], "left_anti")


def cuts(phrases: DataFrame, words: DataFrame, totals: DataFrame, all_phrases: DataFrame, scale: int) -> DataFrame:
    """lang, phrase, a, l, r, n and score at the lowest cut of each phrase."""
    known = words.select("lang", "phrase", "f").unionAll(all_phrases.select("lang", "phrase", "f"))
    at = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = at.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("tail"))
    left = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    met = parts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang")
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    score = met.withColumn("over", F.lit(scale).cast("decimal(19,0)") * whole[0] * whole[1]).withColumn("under", whole[2] * whole[3]).withColumn("score", F.expr("over div under"))
    lowest = F.min(F.struct("score", "cut", "l", "r"))
    return score.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("at")).select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")


def collocations(docs: DataFrame, depth: int = 5, least: int = 100, scale: int = 1000, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and name."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = written(word_counts(texts), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.where(F.col("f") >= least)
    word_bits = bit_table(word_hashes(words))
    pair_bits = bit_table(written(pair_hashes(texts, word_bits, least), "pair-hashes"))
    found = written(phrase_counts(texts, word_bits, pair_bits, depth).where(F.col("f") >= least), "phrase-counts")
    scored = cuts(not_subsumed(found), words, totals, found, scale)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
