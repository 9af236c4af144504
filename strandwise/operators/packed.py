"""k-mers packed into 64-bit integers, two bits a base, and counted before they are shuffled.

Packing all windows of a sequence is one shift and one or of whole arrays for each of the k places, which Spark's
string expressions can't say: they would make a string a window. So sequences go to numpy in Arrow batches, come
back as distinct codes with their numbers, and all else (adding up, the other strand, letters) stays in the JVM.

Windows with letters other than A, C, G and T are counted as strings. k is at most 31. Null sequences have no windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 31
#: Bases that are packed at once: bounds a task's memory whatever the length of a sequence.
BLOCK = 2_000_000
#: What is no base: other letters, and borders of sequences.
OTHER, BORDER = 4, 5


def _codes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    table[10] = BORDER
    return table


def windows(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: its code (0 where a letter is no base) and the worst of its letters' codes."""
    n = max(0, len(bases) - k + 1)
    code, worst = np.zeros(n, np.int64), np.zeros(n, np.uint8)
    for i in range(k):
        here = bases[i : i + n]
        np.maximum(worst, here, out=worst)
        code = (code << 2) | (here & 3)
    return code, worst


def other_strand(code: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(code)
    for _ in range(k):
        out = (out << 2) | (3 - (code & 3))
        code = code >> 2
    return out


def _complement(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def counted(seqs: DataFrame, k: int, both: bool, seq: str = "seq") -> DataFrame:
    """code or odd (a string with other letters), and n; with both, of a window and its other strand the lesser stands for both."""
    table = _codes()

    def block(text: bytes) -> Iterator[pd.DataFrame]:
        bases = table[np.frombuffer(text, np.uint8)]
        code, worst = windows(bases, k)
        odd = Counter(text[i : i + k].decode() for i in np.flatnonzero(worst == OTHER).tolist())
        if both and odd:
            odd = sum((Counter({min(s, _complement(s)): n}) for s, n in odd.items()), Counter())
        code = code[worst < OTHER]
        if both:
            code = np.minimum(code, other_strand(code, k))
        values, n = np.unique(code, return_counts=True)
        if len(values):
            yield pd.DataFrame({"code": values, "odd": pd.array([None] * len(values), dtype="string"), "n": n})
        if odd:
            yield pd.DataFrame({"code": pd.array([None] * len(odd), dtype="Int64"), "odd": list(odd), "n": list(odd.values())})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for s in frame["s"]:
                data = s.encode()
                for i in range(0, max(1, len(data) - k + 1), BLOCK):
                    held.append(data[i : i + BLOCK + k - 1])
                    size += len(held[-1])
                    if size >= BLOCK:
                        yield from block(b"\n".join(held))
                        held, size = [], 0
        if held:
            yield from block(b"\n".join(held))

    rows = seqs.where(F.length(seq) >= k).select(F.col(seq).alias("s")).mapInPandas(run, "code long, odd string, n long")
    return rows.groupBy("code", "odd").agg(F.sum("n").alias("n"))


def letters(code: Column, k: int) -> Column:
    """A code's k bases."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
