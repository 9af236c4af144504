"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (a line of the text) is hashed to a wide vector of 32-bit lanes; a document's
fingerprint is the sum of its paragraphs' vectors modulo 2**32. Sums don't depend on order, and a
paragraph is added or taken away by adding or subtracting its vector. EQUAL lanes are the paragraph's
512-bit blake2b digest and tell multisets apart. LIKE lanes add +1 or -1 for each unit of the paragraph
(a run of words that ends at a word chosen by its hash), so that the cosine of two documents' lanes,
read as signed numbers, estimates the cosine of their multisets of units.

Null texts count as empty; an empty text has one empty paragraph. Equal texts have equal fingerprints
and likeness 1; two texts without any unit but with different paragraphs have likeness 0. Repeated
rows, equal or null doc_ids each give a row: a null doc_id counts as the smallest, equal ones follow
each other by their compressed text. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandwise.llm.common import RangeHash, decompressed, in_order, joined_bytes, mix64, utf8, word_bounds

EQUAL, LIKE = 16, 96
#: A unit ends at each word whose hash is 0 modulo this.
UNIT_WORDS = 4
STEP = np.uint64(0x9E3779B97F4A7C15)


def lanes(texts: list[str]) -> np.ndarray:
    """uint32 array of shape (texts, EQUAL + LIKE)."""
    if not texts:
        return np.zeros((0, EQUAL + LIKE), np.uint32)
    data = [utf8(t) for t in texts]
    buffer, starts = joined_bytes(data)
    hashes = RangeHash(buffer)
    ends = np.flatnonzero(buffer == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    whole = memoryview(buffer)
    digests = [hashlib.blake2b(whole[a:b], digest_size=4 * EQUAL).digest() for a, b in zip(begins.tolist(), ends.tolist())]
    wide = np.frombuffer(b"".join(digests), "<u4").reshape(-1, EQUAL)
    out = np.empty((len(texts), EQUAL + LIKE), np.uint32)
    out[:, :EQUAL] = np.add.reduceat(wide, np.searchsorted(begins, starts[:-1]), axis=0, dtype=np.uint32)
    out[:, EQUAL:] = 0
    first, last = word_bounds(buffer)
    if not len(first):
        return out
    line = np.searchsorted(ends, first)
    closes = hashes.of(first, last) % np.uint64(UNIT_WORDS) == 0
    closes[:-1] |= line[1:] != line[:-1]
    closes[-1] = True
    stop = np.flatnonzero(closes)
    start = np.concatenate([[0], stop[:-1] + 1])
    unit = hashes.of(first[start], last[stop])
    words = mix64(unit[:, None] + STEP * np.arange(101, 103, dtype=np.uint64))
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, :LIKE]
    place = np.searchsorted(first[start], starts)
    full = np.flatnonzero(place[1:] > place[:-1])
    ones = np.add.reduceat(bits, place[full], axis=0, dtype=np.int64)
    out[full, EQUAL:] = (2 * ones - (place[full + 1] - place[full])[:, None]).astype(np.uint32)
    return out


def as_text(vectors: np.ndarray) -> list[str]:
    return [v.astype("<u4").tobytes().hex() for v in vectors]


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<u4")


def inserted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint with these paragraphs more."""
    return as_text((from_text(fingerprint) + lanes(paragraphs).sum(axis=0, dtype=np.uint32))[None])[0]


def deleted(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint with these paragraphs less."""
    return as_text((from_text(fingerprint) - lanes(paragraphs).sum(axis=0, dtype=np.uint32))[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else the cosine of the LIKE lanes, not below 0 or above 1."""
    x, y = (v[:, EQUAL:].astype(np.int32).astype(np.float64) for v in (a, b))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = (x * y).sum(axis=1) / np.where(size > 0, size, 1)
    return np.where((a == b).all(axis=1), 1.0, np.clip(cosine, 0, 1))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edit with the next document in descending doc_id."""
    ordered, _ = in_order(docs, descending=True, neighbours=True)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for frame in frames:
            for row in frame[["part", "guest", "doc_id", "z"]].itertuples(index=False):
                held.append((row.part, row.guest, row.doc_id, decompressed(row.z)))
                size += len(held[-1][3])
                if size > 1_000_000:
                    yield from pairs(held)
                    held = held[-1:]
                    size = 0
        yield from pairs(held)

    def pairs(held: list[tuple]) -> Iterator[pd.DataFrame]:
        """All rows of held but the last and the guests, each with the row after it."""
        keep = [i for i in range(len(held) - 1) if not held[i][1]]
        if not keep:
            return
        own = lanes([h[3] for h in held])
        changed = [edited(held[i][3], held[i + 1][3]) for i in keep]
        other = lanes(changed)
        at = np.array(keep, dtype=np.int64)
        yield pd.DataFrame(
            {
                "doc_id": pd.array([held[i][2] for i in keep], dtype="Int64"),
                "n_chars": [len(held[i][3]) for i in keep],
                "edited_sha256": [hashlib.sha256(utf8(t)).hexdigest() for t in changed],
                "fingerprint": as_text(own[at]),
                "edited_fingerprint": as_text(other),
                "near_edited": likeness(own[at], other),
                "near_next": likeness(own[at], own[at + 1]),
            }
        )

    return ordered.mapInPandas(digest, SCHEMA)
