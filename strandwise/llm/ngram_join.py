"""Jaccard join of documents on word shingles, and the classes that its links make.

A document's set: its words (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased), five at a
time, distinct; with one to four words the whole sequence as one shingle; without words nothing, and
no links. Two documents link when 100 * intersection >= 80 * union. Shingles are 64-bit hashes.

1. Documents with equal sets are one class, found by two 64-bit sums over the set; only classes go on.
2. All share one order of shingles, rare first: those of a fixed part of the hash space (the pool) by
   their exact count over all sets, the rest behind them by hash, the most frequent ones last. The pool
   is larger than a prefix, so most prefixes lie in it and lose their commonest third.
3. A class's prefix is its first n - ceil(0.8 n) + 1 shingles: two sets that link share one in both
   prefixes. Each entry carries its position and how many later shingles lie in each quarter of the
   hash range, which bound the overlap (positional and suffix filters), and the size (length filter).
   Parity bits of the whole set bound from below how many shingles two sets do not share. Shingles that
   no other set holds are only counted; of shingles that the same sets hold, one stays.
4. Since links are asked for as classes, the join goes in two rounds: first every list of sets with a
   common prefix shingle is joined to its centre, the set with the fewest shingles of its own, and what
   links becomes a component; then the sets of a list that lie in different components are joined with
   each other. Pairs that pass the filters are verified once a round, on whole texts. Nothing is lost: a
   pair in one component can't change the classes, every other is examined.

Null texts have no words. Rows without a doc_id have component null. Repeated rows are one class; of
rows with one doc_id and different texts each is judged by its own text. An empty table gives an empty
one. Extra columns are ignored. A long text is one array of its shingles, some 60 bytes of memory a
byte of text, in one task; only its pooled shingles leave it, a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import RangeHash, joined_bytes, mix64, partitions, slices, tidy, utf8, word_bounds
from strandwise.llm.components import components
from strandwise.session import discard, written

WORDS = 5
SIMILAR, WHOLE = 80, 100
SKETCH_BITS, CHUNKS = 20, 64
#: Share of the hash space whose shingles are counted exactly and come first in the common order.
POOL = 0.3
#: Longs of parity bits of a set: two sets differ in as many shingles at least as their bits do.
PARITY = 16
#: A hub's pairs are dealt to so many groups, each with its own copy of the hub's text.
SALTS = 16
#: Least and most bits of the filter that keeps texts which no pair needs out of the shuffle.
FILTER_BITS = 16, 27
ODD = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted uint64 hashes."""
    if not texts:
        return []
    buffer, starts = joined_bytes([utf8(t).lower() for t in texts])  # bytes.lower() knows A-Z only
    first, last = word_bounds(buffer)
    words = RangeHash(buffer).of(first, last)
    at = np.searchsorted(first, starts)
    rolled = words[: max(0, len(words) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        rolled *= ODD
        rolled += words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                with np.errstate(over="ignore"):
                    whole = whole * ODD + w
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that only equal sets share."""
    a, b = mix64(shingles).sum(dtype=np.uint64), mix64(shingles ^ ODD).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR * n // WHOLE) + 1


def first_pass(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, a, b, n) of documents, and rows (chunk, counts) of each task's part of the counters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for frame in slices(frames, most=500_000):
            sets = shingle_sets(frame["text"].tolist())
            places = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
            counters += np.bincount(places.astype(np.int64), minlength=len(counters)).astype(np.uint32)
            sums = [signature(s) for s in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "a": [s[0] for s in sums], "b": [s[1] for s in sums], "n": [len(s) for s in sets], "chunk": pd.array([None] * len(sets), dtype="Int32"), "counts": None})
        if counters.any():
            yield pd.DataFrame({"doc_id": pd.array([None] * CHUNKS, dtype="Int64"), "a": 0, "b": 0, "n": 0, "chunk": pd.array(range(CHUNKS), dtype="Int32"), "counts": [zlib.compress(c.tobytes(), 1) for c in counters.reshape(CHUNKS, -1)]})

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, a long, b long, n int, chunk int, counts binary")


def frequent_places(parts: DataFrame) -> np.ndarray:
    """Which counters hold shingles too frequent to be counted one by one.

    A counter is frequent beyond 4096 and twice the mean of all, so any other shingle has so many rows at most: a
    share of all rows that shrinks to 2 / 2**SKETCH_BITS, far below what one task reads.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, data in zip(frame["chunk"], frame["counts"]):
                counts = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + counts if chunk in sums else counts
        for chunk, counts in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "sums": [zlib.compress(counts.tobytes(), 1)]})

    rows = parts.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(min(CHUNKS, partitions(parts.sparkSession)), "chunk").mapInPandas(add, "chunk int, sums binary").collect()
    sums = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint64)
    for row in rows:
        sums[row.chunk] = np.frombuffer(zlib.decompress(row.sums), np.uint64)
    return sums.ravel() > 4096 + 2 * sums.mean()


def quarters(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(62)).astype(np.int64), minlength=4)


def later_quarters(totals: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """For each of the passed shingles, how many later ones are in each quarter of the hash range, 16 bits each."""
    met = np.cumsum((passed >> np.uint64(62)).astype(np.int64)[:, None] == np.arange(4), axis=0)
    return ((totals - met) << (16 * np.arange(4))).sum(axis=1)


def parities(mixed: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * PARITY cells: whether an odd number of the set's shingles falls into it."""
    odd = np.bincount((mixed % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


SETS = "a long, b long, n int, behind array<int>, parity array<long>, pool array<long>, rest array<long>, rest_later array<long>"


def second_pass(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row a task for each set: sums, size, pooled shingles, and what its prefix holds behind these if they don't fill it.

    behind: how many shingles outside the pool lie in each quarter of the hash range.
    """
    packed = zlib.compress(np.packbits(frequent).tobytes(), 1)
    limit = np.uint64(int(POOL * 2**64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).view(bool)
        met: set[tuple[int, int]] = set()
        for frame in slices(frames, most=500_000):
            rows = []
            for shingles in shingle_sets(frame["text"].tolist()):
                if not len(shingles):
                    continue
                sums = signature(shingles)
                if sums in met:
                    continue
                if len(met) < 500_000:
                    met.add(sums)
                last = marks[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                mixed = mix64(shingles ^ ODD)
                first = (mixed < limit) & ~last
                pool = shingles[first]
                behind = quarters(shingles) - quarters(pool)
                rest = np.concatenate([shingles[~first & ~last], shingles[last]])[: max(0, prefix_length(len(shingles)) - len(pool))]
                later = later_quarters(behind, rest) if len(shingles) <= 65_535 else np.full(len(rest), -1, np.int64)
                rows.append((*sums, len(shingles), behind, parities(mixed), pool.view(np.int64), rest.view(np.int64), later))
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "n", "behind", "parity", "pool", "rest", "rest_later"])

    return docs.select("text").mapInPandas(tidy(run), SETS)


def id_filter(ids: DataFrame, size: int) -> np.ndarray:
    """A bitmap of 2**size places in which every id's place is set."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << size, bool)
        for frame in frames:
            bits[filter_place(frame["id"].to_numpy(np.int64), size)] = True
        for chunk, part in enumerate(bits.reshape(CHUNKS, -1)):
            if part.any():
                yield pd.DataFrame({"chunk": [chunk], "bits": [zlib.compress(np.packbits(part).tobytes(), 1)]})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, data in zip(frame["chunk"], frame["bits"]):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                sums[chunk] = sums[chunk] | part if chunk in sums else part
        for chunk, part in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "bits": [zlib.compress(part.tobytes(), 1)]})

    out = np.zeros((CHUNKS, (1 << size) // CHUNKS // 8), np.uint8)
    schema = "chunk int, bits binary"
    for row in ids.mapInPandas(mark, schema).repartition(min(CHUNKS, partitions(ids.sparkSession)), "chunk").mapInPandas(join, schema).collect():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return np.unpackbits(out.ravel()).view(bool)


def filter_place(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) >> np.uint64(64 - size)).astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (x, y) of class ids whose documents' texts link, as (a, b)."""
    pairs = written(pairs, "pairs")
    needed = written(pairs.select(F.col("x").alias("id")).unionAll(pairs.select(F.col("y").alias("id"))).distinct(), "pair-ids")
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * needed.count()).bit_length()))
    bits = np.packbits(id_filter(needed, size)).tobytes()

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for frame in frames:
            frame = frame[frame["doc_id"].notna()]
            frame = frame[marks[filter_place(frame["doc_id"].to_numpy(np.int64), size)]]
            if len(frame):
                yield frame

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(wanted, "doc_id long, text string")
    texts = texts.join(needed, texts["doc_id"] == needed["id"]).select("id", "text")
    texts = written(texts, "pair-texts")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int"))
    others = salted.join(texts, salted["y"] == texts["id"]).select("x", "salt", "y", "text")
    hubs = salted.select("x", "salt").distinct().join(texts, F.col("x") == F.col("id")).select("x", "salt", F.lit(None).cast("long").alias("y"), "text")
    dealt = hubs.unionAll(others).repartition(partitions(docs.sparkSession), "x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sets = None, []
        for frame in slices(frames, most=500_000):
            out = []
            for x, salt, y, shingles in zip(frame["x"], frame["salt"], frame["y"], shingle_sets(frame["text"].tolist())):
                if pd.isna(y):
                    sets = [*sets, shingles] if own == (x, salt) else [shingles]  # rows of one doc_id may differ
                    own = x, salt
                elif any(linked(s, shingles) for s in sets):
                    out.append((x, int(y)))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    links = written(dealt.mapInPandas(tidy(check), "a long, b long").distinct(), "links")
    for done in (texts, needed, pairs):
        discard(done)
    return links


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return WHOLE * common >= SIMILAR * (len(both) - common)


def prefix_entries(sets: DataFrame, slim: DataFrame) -> DataFrame:
    """id, n, shingle, pos and later of each prefix shingle that other sets hold too.

    Pooled shingles are counted over all sets; those of one set alone come first in its order and are passed over by
    number only. A set that several tasks met counts several times, which any order allows.
    """
    each = Window.partitionBy("shingle")
    pooled = sets.select("a", F.explode("pool").alias("shingle"))
    shared = pooled.withColumn("low", F.min("a").over(each)).withColumn("high", F.max("a").over(each)).withColumn("df", F.count("*").over(each))
    shared = shared.where("low <> high").select("a", "shingle", "df").repartition("a").groupBy("a", "shingle").agg(F.min("df").alias("df"))
    mine = Window.partitionBy("a")
    ordered = mine.orderBy("df", "shingle")
    # What is left behind a row is the whole less what came up to it: frames that start at the first row are added up once.
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ones = [(F.expr("shiftrightunsigned(shingle, 62)") == k).cast("long") for k in range(4)]
    quarter = [F.sum(one).over(mine) - F.sum(one).over(upto) for one in ones]
    ranked = shared.select("a", "shingle", F.count("*").over(mine).alias("shared"), F.row_number().over(ordered).alias("rank"), *[q.alias(f"q{k}") for k, q in enumerate(quarter)])
    placed = ranked.join(slim.select("a", "id", "n", "u", "behind"), "a").withColumn("pos", (F.col("u") - F.col("shared") + F.col("rank") - 1).cast("int"))
    packed = " + ".join(f"shiftleft(behind[{k}] + q{k}, {16 * k})" for k in range(4))
    first = placed.where(f"pos <= n - ({SIMILAR} * n + {WHOLE - 1}) div {WHOLE}").select("id", "n", "shingle", "pos", F.expr(f"case when n > 65535 then -1 else {packed} end").alias("later"))
    rest = slim.where(F.size("rest") > 0).select("id", "n", "u", F.posexplode(F.arrays_zip("rest", "rest_later")).alias("at", "entry"))
    return first.unionByName(rest.select("id", "n", F.col("entry.rest").alias("shingle"), (F.col("u") + F.col("at")).cast("int").alias("pos"), F.col("entry.rest_later").alias("later")))


def postings(entries: DataFrame) -> DataFrame:
    """entries of one shingle for each list of sets, with the list's centre (c_id, c_n, c_pos, c_later).

    Shingles that the same sets hold pair the same sets: one of them is enough. The centre is the set with the fewest
    shingles before this one, so the one that holds least of its own.
    """
    centre = F.min_by(F.struct("id", "n", "pos", "later"), F.struct("pos", "id")).alias("c")
    lists = entries.groupBy("shingle").agg(F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"), F.count("*").alias("many"), centre).where("many > 1")
    one = lists.groupBy("x", "y", "many").agg(F.min_by(F.struct("shingle", "c"), "shingle").alias("l"))
    one = one.select(F.col("l.shingle").alias("shingle"), *[F.col(f"l.c.{c}").alias(f"c_{c}") for c in ("id", "n", "pos", "later")])
    return entries.join(one, "shingle")


def may_link(x: str, y: str) -> str:
    """The length, positional and suffix filters at a shingle that both prefixes hold."""
    share = " + ".join(f"least((shiftrightunsigned({x}later, {16 * k}) & 65535), (shiftrightunsigned({y}later, {16 * k}) & 65535))" for k in range(4))
    shorter = f"least({x}n - {x}pos, {y}n - {y}pos) - 1"
    most = f"case when {x}later = -1 or {y}later = -1 then {shorter} else least({shorter}, {share}) end"
    return (
        f"{WHOLE} * least({x}n, {y}n) >= {SIMILAR} * greatest({x}n, {y}n)"
        f" and {WHOLE + SIMILAR} * (1 + least({x}pos, {y}pos) + {most}) >= {SIMILAR} * ({x}n + {y}n)"
    )


def centre_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (x, y) of a list's centre and another set of it that pass the filters."""
    return lists.where("id <> c_id").where(may_link("", "c_")).select(F.col("c_id").alias("x"), F.col("id").alias("y")).distinct()


def prefix_pairs(lists: DataFrame, slim: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes in different components that pass all filters at a shared prefix shingle."""
    tied = lists.join(parts, lists["id"] == parts["node"], "left").select("id", "n", "shingle", "pos", "later", F.coalesce("component", "id").alias("part"))
    tied = written(tied, "tied-entries")
    mixed = tied.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("shingle")
    odd = slim.select(F.col("id").alias("own"), *[F.col("parity")[i].alias(f"odd{i}") for i in range(PARITY)])
    left = tied.join(mixed, "shingle")
    left = written(left.join(odd, left["id"] == odd["own"]).drop("own"), "mixed-entries")
    x, y = left.alias("x"), left.alias("y")
    apart = " + ".join(f"bit_count(x.odd{i} ^ y.odd{i})" for i in range(PARITY))
    met = x.join(y, F.expr(f"x.shingle = y.shingle and x.id < y.id and x.part <> y.part and {may_link('x.', 'y.')} and {WHOLE + SIMILAR} * ({apart}) <= {WHOLE - SIMILAR} * (x.n + y.n)"))
    return met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()


def class_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows with their sets' sums, the classes of rows with equal sets (id: least doc_id), their sets, and their postings."""
    first = written(first_pass(docs), "shingle-sums")
    rows = first.where(F.col("chunk").isNull()).select("doc_id", "a", "b", "n")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("id")), "classes")
    sets = written(second_pass(docs, frequent_places(first)), "sets")
    slim = sets.select("a", "b", "n", F.size("pool").alias("u"), "behind", "parity", "rest", "rest_later").join(classes, ["a", "b"]).dropDuplicates(["id"])
    slim = written(slim.drop("b"), "slim-sets")
    entries = written(prefix_entries(sets, slim), "prefix-entries")
    discard(sets)
    lists = written(postings(entries), "postings")
    discard(entries)
    return rows, classes, slim, lists


def links_of(docs: DataFrame) -> DataFrame:
    """a and b: every pair of classes of equal sets (named by least doc_id) that link."""
    _, _, slim, lists = class_sets(docs)
    alone = slim.select(F.col("id").alias("node"), F.col("id").alias("component"))
    links = verified(prefix_pairs(lists, slim, alone), docs)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows, classes, slim, lists = class_sets(docs)
    parts = written(components(verified(centre_pairs(lists), docs)), "centre-parts")
    far = verified(prefix_pairs(lists, slim, parts), docs)
    for done in (lists, slim):
        discard(done)
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(far)
    whole = written(components(links), "parts")
    named = classes.join(whole, classes["id"] == whole["node"], "left").select("a", "b", F.coalesce("component", "id").alias("component_id"))
    named = written(named, "class-names")
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
