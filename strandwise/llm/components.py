"""Connected components of a graph given as edges, by alternating stars.

In a large star every node's greater neighbours are tied to the least node it knows; in a small star
its lesser neighbours and itself are. Both only need each node's least neighbour, an aggregate that is
combined before it is shuffled, and a join that Spark can split where a node has many edges. Rounds go
on until nothing changes; their number grows with the logarithm of the nodes. Edges stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.session import discard, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) for every node of edges (a, b); loops and repeats do no harm."""
    tied = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tied = written(tied, "edges")
    state = _state(tied)
    while state[0]:
        both = tied.unionAll(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tied.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "small-star")
        discard(large)
        discard(tied)
        tied, before, state = after, state, _state(after)
        if state == before:
            break
    return tied.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tied.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
