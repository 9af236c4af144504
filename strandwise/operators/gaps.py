"""Closing gaps of several missing bases: a search from both sides over known k-mers.

A known k-mer is an edge from its first k - 1 bases to its last. A string closes a gap if every window of k bases over it is
known: if it is a walk from the k - 1 bases before the gap to those behind it. Both sides walk by turns, one edge a round,
and meet in the middle, so each goes half the way. Walks of one length that end in the same k - 1 bases go on as one, with the
number of strings they stand for, so a side has at most as many rows a gap as there are such ends, and none is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import part_of
from strandwise.session import written

GAP = ["read_id", "orig_pos"]


def gaps(reads: DataFrame) -> DataFrame:
    """read_id, seq and orig_pos of each underscore."""
    here = F.filter(F.sequence(F.lit(0), F.length("seq") - 1), lambda p: part_of(F.col("seq"), p, 1) == "_")
    return reads.where(F.col("seq").contains("_")).select("read_id", "seq", F.explode(here.cast("array<bigint>")).alias("orig_pos"))


def _stepped(side: DataFrame, edges: DataFrame, text: Column) -> DataFrame:
    """The walks of side, one edge (node, next and base) further."""
    each = side.join(edges, "node").select(*GAP, F.col("next").alias("node"), text.alias("text"), "ways")
    return each.groupBy(*GAP, "node").agg(F.min("text").alias("text"), F.least(F.sum("ways"), F.lit(2)).cast("long").alias("ways"))


def closed(reads: DataFrame, known: DataFrame, k: int, longest: int = 10) -> DataFrame:
    """read_id, orig_pos, fill and ways of every gap (underscore) of the reads.

    fill: the shortest string of at most `longest` bases, the empty one included, with which every window of k bases over
    the gap is known (kmer); null if there is none (ways 0) or if several of that length do (ways 2).
    Defined cases: a gap with fewer than k - 1 bases on a side, or with another gap among them, has none; null and empty
    sequences have no gaps; a read_id must be unique; no known k-mers leave every gap open. k is at least 2.
    """
    names = known.select("kmer").where(F.length("kmer") == k).distinct()
    kmer = F.col("kmer")
    forward = written(names.select(F.left(kmer, F.lit(k - 1)).alias("node"), F.right(kmer, F.lit(k - 1)).alias("next"), F.right(kmer, F.lit(1)).alias("base")), "gap-edges")
    backward = forward.select(F.col("next").alias("node"), F.col("node").alias("next"), F.left("node", F.lit(1)).alias("base"))
    all_ = written(gaps(reads).select(*GAP, part_of(F.col("seq"), F.greatest(F.col("orig_pos") - (k - 1), F.lit(0)), F.least(F.col("orig_pos"), F.lit(k - 1)).cast("int")).alias("before"), part_of(F.col("seq"), F.col("orig_pos") + 1, k - 1).alias("behind")), "gaps")
    whole = all_.where((F.length("before") == k - 1) & (F.length("behind") == k - 1) & ~F.col("before").contains("_") & ~F.col("behind").contains("_"))
    one = F.lit(1).cast("long").alias("ways")
    left = whole.select(*GAP, F.col("before").alias("node"), F.lit("").alias("text"), one)
    right = whole.select(*GAP, F.col("behind").alias("node"), F.col("behind").alias("text"), one)
    found = all_.where(F.lit(False)).select(*GAP, F.lit("").alias("fill"), F.lit(0).alias("ways"))
    for step in range(1, k + longest):
        if step % 2:
            left = written(_stepped(left, forward, F.concat("text", "base")), "gap-left")
        else:
            right = written(_stepped(right, backward, F.concat("base", "text")), "gap-right")
        size = step - (k - 1)
        if size < 0:
            continue
        ends = right.select(*GAP, "node", F.col("text").alias("rest"), F.col("ways").alias("others"))
        fill = F.left(F.concat("text", F.substring("rest", F.lit(k), F.length("rest"))), F.lit(size))
        met = left.join(ends, [*GAP, "node"]).select(*GAP, fill.alias("fill"), (F.col("ways") * F.col("others")).alias("ways"))
        met = met.groupBy(*GAP).agg(F.min("fill").alias("fill"), F.least(F.sum("ways"), F.lit(2)).cast("int").alias("ways"))
        met = written(met, "gap-closed")
        found = found.unionByName(met)
        left, right = (side.join(met.select(*GAP), GAP, "left_anti") for side in (left, right))
        if step % 2 and left.isEmpty():
            break
    out = all_.select(*GAP).join(found, GAP, "left").withColumn("ways", F.coalesce("ways", F.lit(0)))
    return out.select(*GAP, F.when(F.col("ways") == 1, F.col("fill")).alias("fill"), "ways")


def filled(reads: DataFrame, fills: DataFrame) -> DataFrame:
    """reads with corrected: each underscore gives way to its fill (read_id, orig_pos, fill); without one it stays."""
    each = F.map_from_entries(F.collect_list(F.struct(F.col("orig_pos").cast("int"), "fill"))).alias("fills")
    lists = fills.where("fill is not null").groupBy("read_id").agg(each)
    here = F.sequence(F.lit(0), F.length("seq") - 1)
    put = lambda p: F.when(part_of(F.col("seq"), p, 1) == "_", F.coalesce(F.try_element_at("fills", p), F.lit("_"))).otherwise(part_of(F.col("seq"), p, 1))
    met = reads.join(lists, "read_id", "left")
    return met.withColumn("corrected", F.when(F.col("fills").isNull(), F.col("seq")).otherwise(F.array_join(F.transform(here, put), ""))).drop("fills")
