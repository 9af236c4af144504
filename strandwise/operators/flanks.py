"""Parts of reads around places, so that work at a place doesn't grow with its read.

Reads are cut once into overlapping pieces, each the owner of SPAN places, and every place meets its one owner.
Positions count from 0; sequences are ASCII. A read_id must be unique among the reads; null and empty reads have no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import part_of

#: Places that a piece owns.
SPAN = 256


def pieces(reads: DataFrame, left: int, right: int) -> DataFrame:
    """read_id, size (of the read), piece, begin (where part begins in the read) and part: SPAN places and so many bases on each side."""
    size = F.length("seq")
    each = reads.where(size > 0).select("read_id", "seq", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / SPAN).cast("int"))).alias("piece"))
    begin = F.greatest(F.col("piece") * SPAN - left, F.lit(0))
    part = part_of(F.col("seq"), begin, F.col("piece") * SPAN + SPAN + right - begin)
    return each.select("read_id", "size", "piece", begin.alias("begin"), part.alias("part"))


def flanked(at: DataFrame, reads: DataFrame, left: int, right: int) -> DataFrame:
    """at (read_id, orig_pos and more) with size (of the read), place and flank: the base at place in flank is that at orig_pos, with so many bases on each side if there are as many."""
    owned = at.withColumn("piece", F.floor(F.col("orig_pos") / SPAN).cast("int"))
    met = owned.join(pieces(reads, left, right), ["read_id", "piece"])
    within = (F.col("orig_pos") - F.col("begin")).cast("int")
    first = F.greatest(within - left, F.lit(0))
    return met.select(*at.columns, "size", (within - first).alias("place"), part_of(F.col("part"), first, within - first + 1 + right).alias("flank"))
