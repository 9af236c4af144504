"""Best-fit packing by minimum bin slack.

Documents are tokenized, ended with the end id, and cut into pieces of at most `size` ids, all but the
first of a cut document full. Which pieces share a sequence depends on their lengths alone, so bins
are filled from the histogram of lengths, which has at most `size` entries whatever the input: a bin
takes the longest length left, then a subset-sum dynamic program over the lengths available, each a
shift of a bitset, finds the fullest combination with the rest of the room. That combination is removed, as
many times as the counts allow, and the next bin is filled. Each such step leaves less than one more
combination's worth of some length, so the number of different combinations is bounded by `size` and
the halvings of its multiplicities, not by the input.

Pieces are then numbered within their length (per length and salt, so that no length lies in one task),
and each number falls into one range of one combination's slots.

Null texts count as empty: a single piece with the end id. Repeated rows, equal or null doc_ids are
packed as rows of their own. Columns other than doc_id and text are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import REMEMBERED, forget_encoders, library_cache, partitions, slices, tidy
from strandwise.session import written

#: Most rows of the slot table that go to every task: one a combination and length.
MOST_SLOTS = 200_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, remembered: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece. remembered: chunks whose ids a worker keeps; lasting: from task to task."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = library_cache(tokenizer, words=False, remembered=remembered)
        end = np.array([end_id], "<u4").tobytes()
        for frame in slices(frames, most=1_000_000):
            rows: list[tuple] = []
            for doc_id, data in zip(frame["doc_id"].astype("Int64"), encode(frame["text"].tolist())):
                data += end
                n = len(data) // 4
                first = n % size or size
                begins = [0, *range(first, n, size)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        if not lasting:
            forget_encoders()

    return docs.select("doc_id", "text").mapInPandas(cut if lasting else tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) available in counts whose sum is the greatest that room holds."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, power = min(counts[length], room // length), 1
        while left:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, power = left - take, power * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, earlier in reversed(steps):
        if not earlier >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def combinations(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by minimum bin slack from the longest length down."""
    counts = {k: n for k, n in histogram.items() if n}
    out: list[tuple[list[int], int]] = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = {k: n for k, n in counts.items() if n}
        chosen = [longest, *fullest(rest, size - longest)]
        counts[longest] += 1
        need = {k: chosen.count(k) for k in set(chosen)}
        times = min(counts[k] // n for k, n in need.items())
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((chosen, times))
    return out


def slot_table(histogram: dict[int, int], size: int) -> pd.DataFrame:
    """For each length, ranges [low, high) of piece numbers and the sequence and offset of the range's first piece."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in combinations(histogram, size):
        offset = 0
        for length in lengths:
            low = used.get(length, 0)
            rows.append((length, low, low + times, sequence, offset))
            used[length] = low + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "first_sequence", "offset"])


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset; `cut` has a column length of at most `size`, and doc_id and piece."""
    spark = cut.sparkSession
    salts = 4 * partitions(spark)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    table = written(cut, "pack-pieces")
    groups = written(table.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-groups")
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(histogram, size)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    numbered = table.withColumn("number", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("number", F.col("number") + F.col("base"))
    ranges = spark.createDataFrame(slots.astype("int64"), "length long, low long, high long, first_sequence long, offset long")
    grouped = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first_sequence", "offset"))).alias("ranges"))
    if len(slots) > MOST_SLOTS:
        raise ValueError("more combinations than lengths allow")
    placed = numbered.join(F.broadcast(grouped), "length").withColumn("slot", F.expr("element_at(filter(ranges, r -> r.low <= number and number < r.high), 1)"))
    return placed.select(
        *[c for c in table.columns if c not in ("salt", "length")],
        "length",
        (F.col("slot.first_sequence") + F.col("number") - F.col("slot.low")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )
