"""Suffix ranks of a genome's two strands and of reads by prefix doubling, and what they say about windows of any size.

A suffix is what a sequence holds from a place on. Its first 21 letters, three bits each, are its first key; a round
replaces the rank of a suffix by that of (its rank, the rank so many letters further on), which doubles the letters that
ranks tell apart. Only suffixes that share their rank go through a round, and rounds end when no two different suffixes do:
their number is the logarithm of the longest repeat, whatever the sequences' lengths. Ranks count the smaller suffixes, so
the next suffix's rank is a rank plus the number of suffixes that share it, and neighbours meet in a plain join. How many
letters neighbours share is looked up in the rounds' tables, from the longest step down.

Per suffix two lengths come out: of the longest window from there that the strands hold at least once, and at least
twice (elsewhere, for the genome's own places). They decide every window: one of n letters is REPEAT up to the second,
TRUSTED up to the first, else UNTRUSTED, so one table stands in for tables of k-mers of all sizes.

Sequences are ASCII; letters other than A, C, G, T, N and underscore count as one. Null and empty sequences have no places.
Ids may repeat only between genome and reads. Equal suffixes share a rank; a key that many suffixes share is counted
before it is sorted, and sorted keys of one rank may be spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import reverse_complement
from strandwise.session import discard, written

#: Letters of a first key, at three bits.
LETTERS = 21
#: Places whose keys are made at once.
BLOCK = 1_000_000
#: A shared length that nothing bounds.
ENDLESS = 1 << 40


def first_keys(texts: DataFrame) -> DataFrame:
    """text, size, genome, pos and key of every place of texts (text, genome, seq); the end counts as the least letter."""
    codes = np.full(256, 7, np.int64)
    codes[np.frombuffer(b"ACGTN_", np.uint8)] = range(1, 7)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, genome, seq in zip(frame["text"], frame["genome"], frame["seq"]):
                letters = np.concatenate([codes[np.frombuffer(seq.encode(), np.uint8)], np.zeros(LETTERS, np.int64)])
                size = len(letters) - LETTERS
                for begin in range(0, size, BLOCK):
                    n = min(BLOCK, size - begin)
                    key = np.zeros(n, np.int64)
                    for i in range(begin, begin + LETTERS):
                        key = (key << 3) | letters[i : i + n]
                    yield pd.DataFrame({"text": text, "size": size, "genome": genome, "pos": np.arange(begin, begin + n), "key": key})

    return texts.where("seq <> ''").select("text", "genome", "seq").mapInPandas(run, "text long, size long, genome boolean, pos long, key long")


def ranked(keys: DataFrame) -> DataFrame:
    """rank, key, new (rank plus the number of rows of this rank with a lesser key) and same (rows of this rank and key)."""
    counted = keys.groupBy("rank", "key").agg(F.count("*").alias("same"))
    dealt = written(counted.repartitionByRange(F.col("rank"), F.col("key")).withColumn("part", F.spark_partition_id()), "suffix-keys")
    parts = dealt.groupBy("rank", "part").agg(F.sum("same").alias("n"))
    split = parts.withColumn("base", F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("base > 0")
    before = Window.partitionBy("part", "rank").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("within", F.coalesce(F.sum("same").over(before), F.lit(0)))
    met = within.join(split.select("rank", "part", "base"), ["rank", "part"], "left")
    return met.select("rank", "key", (F.col("rank") + F.coalesce("base", F.lit(0)) + F.col("within")).alias("new"), "same")


def rounds(places: DataFrame) -> list[DataFrame]:
    """Tables of text, size, genome, pos, key, rank and same after each round; the last one's equal ranks are equal suffixes."""
    keyed = places.withColumn("rank", F.lit(0).cast("long"))
    tables = [written(keyed.join(ranked(keyed), ["rank", "key"]).drop("rank").withColumnRenamed("new", "rank"), "suffix-ranks")]
    span = LETTERS
    while True:
        known = tables[-1]
        open_ = (F.col("same") > 1) & (F.col("pos") + span <= F.col("size"))
        if known.where(open_).isEmpty():
            return tables
        further = known.select("text", (F.col("pos") - span).alias("pos"), F.col("rank").alias("second"))
        active = known.where(open_).drop("same").join(further, ["text", "pos"], "left").withColumn("second", F.coalesce("second", F.lit(-1)))
        active = written(active, "suffix-open")
        fresh = ranked(active.select("rank", F.col("second").alias("key"))).withColumnRenamed("key", "second")
        moved = active.join(fresh, ["rank", "second"]).drop("rank", "second").withColumnRenamed("new", "rank")
        tables.append(written(known.where(~open_).unionByName(moved), "suffix-ranks"))
        discard(active)
        span *= 2


def _shared_letters(a: Column, b: Column) -> Column:
    """How many letters two different keys share from the first on."""
    return F.lit(LETTERS - 1) - F.floor((F.length(F.bin(a.bitwiseXOR(b))) - 1) / 3)


def neighbours(tables: list[DataFrame]) -> DataFrame:
    """rank, of every rank; own (how many of the genome's suffixes share it), and with the ranks before and behind it, the shared letters (0 at the ends)."""
    one = F.min(F.struct("text", "pos", "key"))
    groups = tables[-1].groupBy("rank", "same").agg(one.alias("one"), F.count(F.when(F.col("genome"), 1)).alias("own"))
    groups = written(groups.select("rank", "same", "own", "one.*"), "suffix-groups")
    after = groups.select((F.col("rank") + F.col("same")).alias("rank"), F.col("rank").alias("left"), F.col("text").alias("left_text"), F.col("pos").alias("left_pos"), F.col("key").alias("left_key"))
    pairs = written(groups.select("rank", "text", "pos", "key").join(after, "rank"), "suffix-pairs")
    near = pairs.where("key <> left_key").select("rank", "left", _shared_letters(F.col("key"), F.col("left_key")).cast("long").alias("shared"))
    deep = pairs.where("key = left_key").select("rank", "left", "text", "pos", "left_text", "left_pos", F.lit(0).cast("long").alias("shared"))

    def looked_up(deep: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for text, pos, name in (("text", "pos", "a"), ("left_text", "left_pos", "b")):
            here = table.select(F.col("text").alias("__text"), F.col("pos").alias("__pos"), F.col(column).alias(name))
            deep = deep.join(here, (F.col("__text") == F.col(text)) & (F.col("__pos") == F.col(pos) + F.col("shared")), "left").drop("__text", "__pos")
        return deep

    for step in reversed(range(len(tables) - 1)):
        met = looked_up(deep, tables[step], "rank")
        more = F.when(F.col("a") == F.col("b"), LETTERS << step).otherwise(0)
        deep = written(met.withColumn("shared", F.col("shared") + more).drop("a", "b"), "suffix-shared")
    rest = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(_shared_letters(F.col("a"), F.col("b")))
    deep = looked_up(deep, tables[0], "key").select("rank", "left", (F.col("shared") + rest).alias("shared"))
    heights = written(near.unionByName(deep), "suffix-heights")
    out = groups.select("rank", "own").join(heights.select("rank", F.col("shared").alias("before")), "rank", "left")
    out = out.join(heights.select(F.col("left").alias("rank"), F.col("shared").alias("behind")), "rank", "left")
    return out.select("rank", "own", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("behind", F.lit(0)).alias("behind"))


def _passed(state: tuple[int, int], shared: int, own: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(first, second) lengths shared with the genome's suffixes passed so far, as a rank sees them and as it leaves them."""
    seen = min(state[0], shared), min(state[1], shared)
    return seen, seen if not own else (ENDLESS, seen[0] if own == 1 else ENDLESS)


def one_sided(near: DataFrame, behind: bool) -> DataFrame:
    """rank, first and second: the two longest shares with the genome's suffixes of all lesser (behind: greater) ranks.

    Each task passes once over its range of ranks; what a range hands to the next one is four numbers, gathered on the
    driver, one row a range.
    """
    shared = "behind" if behind else "before"
    order = F.col("rank").desc() if behind else F.col("rank").asc()
    dealt = near.select("rank", "own", F.col(shared).alias("shared")).repartitionByRange(order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "suffix-ranges")
    sums = dealt.groupBy("part").agg(F.min("shared").alias("least"), F.sum("own").alias("own"), F.max(F.when(F.col("own") > 0, F.col("rank"))).alias("high"), F.min(F.when(F.col("own") > 0, F.col("rank"))).alias("low"))
    last = sums.select("part", F.col("low" if behind else "high").alias("last"))
    later = dealt.join(F.broadcast(last), "part")
    beyond = (F.col("rank") < F.col("last")) if behind else (F.col("rank") > F.col("last"))
    second = later.where(~beyond & (F.col("rank") != F.col("last")) & (F.col("own") > 0)).groupBy("part").agg((F.min("rank") if behind else F.max("rank")).alias("second_last"))
    tail = later.join(F.broadcast(second), "part", "left").groupBy("part").agg(
        F.min(F.when(beyond, F.col("shared"))).alias("to_last"),
        F.min(F.when((F.col("rank") < F.col("second_last")) if behind else (F.col("rank") > F.col("second_last")), F.col("shared"))).alias("to_second"),
        F.max(F.when(F.col("rank") == F.col("last"), F.col("own"))).alias("own_last"),
    )
    handed: dict[int, tuple[int, int]] = {}
    state = (0, 0)
    for r in sorted(sums.join(tail, "part").collect(), key=lambda r: r.part):
        handed[r.part] = state
        passed = (min(state[0], r.least), min(state[1], r.least))
        if r.own:
            first = ENDLESS if r.to_last is None else r.to_last
            if r.own_last > 1:
                other = first
            else:
                other = passed[0] if r.own == 1 else ENDLESS if r.to_second is None else r.to_second
            passed = first, other
        state = passed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = part = None
        for frame in frames:
            out = []
            for rank, own, length, here in zip(frame["rank"].tolist(), frame["own"].tolist(), frame["shared"].tolist(), frame["part"].tolist()):
                if here != part:
                    part, state = here, handed[here]
                seen, state = _passed(state, length, own)
                out.append((rank, *seen))
            yield pd.DataFrame(out, columns=["rank", "first", "second"])

    ordered = dealt.repartition("part").sortWithinPartitions(F.col("part"), order)
    return ordered.mapInPandas(run, "rank long, first long, second long")


def matches(genome: DataFrame, reads: DataFrame | None = None, contig: str = "contig", read_id: str = "read_id") -> DataFrame:
    """of_genome, id, pos, size, once and twice of every place of the genome's forward strand and of the reads.

    once, twice: the letters of the longest window from pos that occurs at least once, at least twice, on the genome's
    two strands; the genome's own place does not count.
    """
    strands = genome.select(F.col(contig).alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("seq")), F.struct(F.lit(1).alias("strand"), reverse_complement(F.col("seq")).alias("seq")))).alias("s"))
    all_ = strands.select("id", "s.strand", "s.seq", F.lit(True).alias("genome"))
    if reads is not None:
        all_ = all_.unionByName(reads.select(F.col(read_id).alias("id"), F.lit(0).alias("strand"), "seq", F.lit(False).alias("genome")))
    # Numbers are a matter of how the rows were dealt; written once, they stay.
    texts = written(all_.withColumn("text", F.monotonically_increasing_id()), "suffix-texts")
    tables = rounds(first_keys(texts))
    near = written(neighbours(tables), "suffix-neighbours")
    left, right = (one_sided(near, behind) for behind in (False, True))
    sides = near.select("rank", "own").join(left, "rank").join(right.select("rank", F.col("first").alias("third"), F.col("second").alias("fourth")), "rank")
    each = tables[-1].select("text", "pos", "size", "genome", "rank").join(sides, "rank")
    others = F.col("own") - F.col("genome").cast("int")
    own_length = F.col("size") - F.col("pos")
    lengths = F.sort_array(F.array("first", "second", "third", "fourth", F.when(others > 0, own_length).otherwise(0), F.when(others > 1, own_length).otherwise(0)), asc=False)
    found = each.select("text", "pos", "size", lengths.alias("lengths"))
    named = found.join(texts.where("strand = 0").select("text", "id", F.col("genome").alias("of_genome")), "text")
    return named.select("of_genome", "id", "pos", "size", F.get("lengths", F.lit(0)).alias("once"), F.get("lengths", F.lit(1)).alias("twice"))


def next_size(length: Column, k: int) -> Column:
    """The least of k, k + 2, ... that is greater than length."""
    return F.when(length < k, k).otherwise(k + 2 * (F.floor((length - k) / 2) + 1)).cast("long")


def unique_windows(genome: DataFrame, k: int = 1) -> DataFrame:
    """contig, pos and n: the shortest of k, k + 2, ... letters from each place that no other place of either strand holds; null if none is."""
    n = next_size(F.col("once"), k)
    return matches(genome).select(F.col("id").alias("contig"), "pos", F.when(F.col("pos") + n <= F.col("size"), n).alias("n"))


def window_class(n: Column, once: Column, twice: Column) -> Column:
    return F.when(n <= twice, "REPEAT").when(n <= once, "TRUSTED").otherwise("UNTRUSTED")


def grown_starts(genome: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """read_id, size, start, class and n of the k-mer at every start of the reads, grown until it is no repeat, without a bound on its size.

    Windows grow by two letters on the right as far as the read goes, then from there by two on the left. n is the deciding
    window's size, null for REPEAT: a window that is repetitive to both ends of the read.
    """
    at = written(matches(genome, reads).where("not of_genome").drop("of_genome").withColumnRenamed("id", "read_id"), "read-matches")
    starts = at.where(F.col("pos") + k <= F.col("size")).withColumn("n", next_size(F.col("twice"), k))
    fits = F.col("pos") + F.col("n") <= F.col("size")
    done = starts.where(fits).select("read_id", "size", F.col("pos").alias("start"), window_class(F.col("n"), F.col("once"), F.col("twice")).alias("class"), "n")
    # The end of the longest repeat from a place never falls from one place to the next, so the first place to the left from
    # which a window to `reach` is no repeat is the greatest one of those.
    late = starts.where(~fits).select("read_id", "size", F.col("pos").alias("start"), (F.col("size") - F.pmod(F.col("size") - F.col("pos") - k, F.lit(2))).alias("reach"))
    ends = late.select("read_id", "reach", F.pmod("start", F.lit(2)).alias("odd")).distinct()
    open_ = at.join(ends, "read_id").where((F.pmod("pos", F.lit(2)) == F.col("odd")) & (F.col("pos") + F.col("twice") < F.col("reach")) & (F.col("pos") + k <= F.col("reach")))
    last = open_.groupBy("read_id", "reach", "odd").agg(F.max_by(F.struct("pos", "once", "twice"), "pos").alias("at"))
    grown = late.withColumn("odd", F.pmod("start", F.lit(2))).join(last, ["read_id", "reach", "odd"], "left")
    n = F.col("reach") - F.col("at.pos")
    grown = grown.select("read_id", "size", "start", F.when(F.col("at").isNull(), "REPEAT").otherwise(window_class(n, F.col("at.once"), F.col("at.twice"))).alias("class"), n.alias("n"))
    return done.unionByName(grown)
