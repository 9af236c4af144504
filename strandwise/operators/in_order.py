"""Correction in reading order: each place is judged with all places before it mended.

A k-mer that starts at a place holds nothing before the place, so a mended place never changes whether a later one is
known; it changes only what explains those whose earlier window, `before` bases further left, reaches back to it. Places
further apart than that don't wait for each other: unknown places fall into stretches, each with its own part of the
read, and a round mends the leftmost place of every stretch that one error explains and judges again only those that the fix
touched. There are as many rounds as one stretch has fixes, however many its read has; a round is two joins with the
known k-mers, and its state is written to the shared folder.

The last k bases of a read share one window, so they and the base before them are one stretch; after a fix among them all
later ones are judged again, and no more than that once that window is known. Each base of the read is judged once and bases put in are not judged, so rounds end
without a cap on fixes. Reads may have any length; a read's unknown places are gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import part_of, undo_error
from strandwise.operators.correction import BEFORE, explained, unknown_places
from strandwise.session import discard, shared_path, written

_FIXES = "array<struct<orig_pos:int,type:string>>"


def stretches(reads: DataFrame, names: DataFrame, k: int, before: int = BEFORE) -> DataFrame:
    """read_id, size (of the read), stretch, places (unknown, rising), begin (where text begins in the read) and text around them.

    A stretch ends where the next unknown place is more than `before` bases on, but never within a read's last k + 1 bases.
    """
    sizes = reads.select("read_id", F.length("seq").alias("size"))
    at = unknown_places(reads, names, k).join(sizes, "read_id")
    order = Window.partitionBy("read_id").orderBy("orig_pos")
    at = at.withColumn("last", F.lag("orig_pos").over(order))
    apart = (F.col("orig_pos") - F.col("last") > before) & (F.col("size") - 1 - F.col("last") > k)
    at = at.withColumn("stretch", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    each = at.groupBy("read_id", "stretch").agg(F.sort_array(F.collect_list(F.col("orig_pos").cast("int"))).alias("places"))
    lists = each.groupBy("read_id").agg(F.collect_list(F.struct("stretch", "places")).alias("all"))
    met = lists.join(reads.select("read_id", "seq"), "read_id")

    def cut(s):
        begin = F.greatest(F.get(s["places"], F.lit(0)) - (k + before + 1), F.lit(0))
        end = F.element_at(s["places"], -1) + k + 2
        return F.struct(s["stretch"].alias("stretch"), s["places"].alias("places"), begin.alias("begin"), part_of(F.col("seq"), begin, end - begin).alias("text"))

    return met.select("read_id", F.length("seq").alias("size"), F.inline(F.transform("all", cut)))


def by_kmers(reads: DataFrame, known: DataFrame, k: int, indels: bool = True, before: int = BEFORE) -> DataFrame:
    """read_id, orig_pos and type as correction.by_kmers, but from left to right: a place is judged in the read as mended so far.

    Defined cases: reads without bases or shorter than k get no corrections; a read_id must be unique; empty tables give
    an empty table; several errors that would do leave a place as it is.
    """
    names = written(known.select("kmer").distinct(), "order-known")
    state = stretches(reads, names, k, before).withColumnsRenamed({"places": "open"})
    state = state.withColumns({"shift": F.lit(0), "stale": F.col("open"), "sure": F.array().cast(_FIXES)})
    state = written(state, "order-stretches")
    path = shared_path(reads.sparkSession, "order-fixes")
    keys = ["read_id", "stretch"]
    fixes = None
    while fixes is None or not state.isEmpty():
        spot = F.col("orig_pos") - F.col("begin") + F.col("shift")
        tried = state.select(*keys, "begin", "shift", "text", F.explode("stale").alias("orig_pos")).withColumn("spot", spot)
        first = F.greatest(F.col("spot") - (k + before + 1), F.lit(0))
        tried = tried.select(*keys, "orig_pos", (F.col("spot") - first).alias("place"), part_of(F.col("text"), first, F.col("spot") - first + k + 2).alias("flank"))
        own = part_of(F.col("flank"), F.least(F.col("place"), F.length("flank") - k), k)
        tried = tried.withColumn("kmer", own).join(names, "kmer", "left_anti").drop("kmer")
        found = explained(tried, names, k, [*keys, "orig_pos"], indels, before)
        fresh = found.groupBy(*keys).agg(F.collect_list(F.struct("orig_pos", "type")).alias("fresh"))
        met = state.join(fresh, keys, "left").withColumn("sure", F.concat("sure", F.coalesce("fresh", F.array().cast(_FIXES)))).drop("fresh", "stale")
        fixed = written(met.withColumn("fix", F.array_min("sure")).where("fix is not null"), "order-round")
        fixes = fixed.select("read_id", F.col("fix.orig_pos").cast("long").alias("orig_pos"), "fix.type")
        fixes.write.mode("append").parquet(path)
        later = written(_mended(fixed, k, before).where("size(stale) > 0 or size(sure) > 0"), "order-stretches")
        discard(state)
        discard(fixed)
        state = later
    return reads.sparkSession.read.schema(fixes.schema).parquet(path)


def _mended(fixed: DataFrame, k: int, before: int) -> DataFrame:
    """The state of stretches after their fix: its text mended, what it touched stale, what lies behind that still sure."""
    p, kind = F.col("fix.orig_pos"), F.col("fix.type")
    back = F.col("size") - 1 - p
    rest = F.filter("open", lambda q: q > p)
    return fixed.select(
        "read_id", "size", "stretch", "begin",
        undo_error(F.col("text"), kind, p - F.col("begin") + F.col("shift")).alias("text"),
        (F.col("shift") + F.when(kind == "INSERTION", -1).when(kind.startswith("DEL"), 1).otherwise(0)).alias("shift"),
        rest.alias("open"),
        F.when(back <= k, rest).otherwise(F.filter(rest, lambda q: q - before <= p)).alias("stale"),
        F.when(back <= k, F.array().cast(_FIXES)).otherwise(F.filter("sure", lambda x: x["orig_pos"] > p + before)).alias("sure"),
    )
