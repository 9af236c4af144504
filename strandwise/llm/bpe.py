"""Byte-level BPE with a hierarchical-bitmap rank queue, and decoding.

Each match of the pattern is encoded on its own, as the tiktoken library does: a pre-token that is a
token itself becomes that id, else its bytes are merged pair by pair, always the pair of least rank,
the leftmost of equal ones. The pairs wait in one bucket a rank, as places in a linked list of parts.
A bitmap of three levels, 64 ways each, marks the ranks whose buckets hold something: three
find-first-set steps give the next rank. Its bucket is worked off from left to right until a merge
makes a pair of lower rank, which goes first. Entries whose pair has changed since are skipped when
they come up. The first pairs are put into their buckets at once, by a table of byte pairs and one sort. A merge
costs a few dictionary look-ups, whatever the length of the pre-token. Many short
pre-tokens share one list, with a byte between them that no token of two or more bytes holds.

Null texts count as empty; an empty text has no ids. Repeated rows, null or equal doc_ids each give a
row. Columns other than doc_id and text are ignored. Decoding gives back the text's own bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from strandwise.llm.common import BYTE_BPE_CUT, MANY, ChunkCache, slices, utf8


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """What waits: the places of each rank, and bitmaps of the ranks and of the bitmaps in use."""

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("three levels hold 262,144 ranks")
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.byte_ranks = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pair_ranks = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair_ranks[token[0] << 8 | token[1]] = rank
        held = {b for token in ranks if len(token) > 1 for b in token}
        #: 0xFE and 0xFF are in no text's UTF-8.
        self.border = next((bytes([b]) for b in (0xFF, 0xFE) if b not in held), None)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of these pre-tokens."""
        get = self.ranks.get
        whole = [get(w) for w in words]
        split = [w for w, rank in zip(words, whole) if rank is None]
        if self.border is None:
            merged = [self.merge(w) for w in split]
        else:
            merged, part, held = [], [], 0
            for w in split:
                part.append(w)
                held += len(w)
                if held > 100_000:
                    merged += self.merge_list(part)
                    part, held = [], 0
            merged += self.merge_list(part)
        following = iter(merged)
        return [next(following) if rank is None else [rank] for rank in whole]

    def merge_list(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        if words:
            last = self.ranks.get(self.border, -1)
            ids: list[int] = []
            for part in self.merge(self.border.join(words)):
                if part == last:
                    out.append(ids)
                    ids = []
                else:
                    ids.append(part)
            out.append(ids)
        return out

    def merge(self, data: bytes) -> list[int]:
        """Ids of the parts left when no pair of neighbours is a token; -1 for a byte that is none."""
        get, n = self.ranks.get, len(data)
        buckets, low, middle, top = self.queue.buckets, self.queue.low, self.queue.middle, 0
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n))  # where the part to the left begins
        codes = np.frombuffer(data, np.uint8).astype(np.int32)
        first = np.append(self.pair_ranks[codes[:-1] << 8 | codes[1:]], np.int32(-1))
        pair = first.tolist()  # rank of this part with the next; -1: no token, or no part begins here
        ids = self.byte_ranks[codes].tolist()  # of the part that begins here
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        held = first[at]
        begins = np.flatnonzero(np.diff(held, prepend=-1))
        places, begins = at.tolist(), begins.tolist()
        for rank, begin, end in zip(held[begins].tolist(), begins, [*begins[1:], len(places)]):
            buckets[rank] = places[begin:end]
            low[rank >> 6] |= 1 << (rank & 63)
            middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            top |= 1 << (rank >> 12)
        entering: list[tuple[int, int]] = []
        while True:
            for rank, i in entering:
                bucket = buckets[rank]
                bucket.append(i)
                if len(bucket) == 1:
                    a = rank >> 6
                    if not low[a]:
                        b = rank >> 12
                        if not middle[b]:
                            top |= 1 << b
                        middle[b] |= 1 << (a & 63)
                    low[a] |= 1 << (rank & 63)
            if not top:
                break
            b = (top & -top).bit_length() - 1
            word = middle[b]
            a = (b << 6) + (word & -word).bit_length() - 1
            word = low[a]
            rank = (a << 6) + (word & -word).bit_length() - 1
            places = buckets[rank]
            buckets[rank] = []
            word &= word - 1
            low[a] = word
            if not word:
                middle[b] &= middle[b] - 1
                if not middle[b]:
                    top &= top - 1
            if len(places) > 1:
                places.sort()
            entering = []
            lower = False
            for k, i in enumerate(places):
                if pair[i] != rank:
                    continue
                if lower:
                    entering += [(rank, j) for j in places[k:]]
                    break
                gone = after[i]
                end = after[i] = after[gone]
                ids[i] = rank
                pair[gone] = -1
                new = -1
                if end < n:
                    before[end] = i
                    new = get(data[i : after[end]], -1)
                    if new >= 0:
                        entering.append((new, i))
                        lower = new < rank
                pair[i] = new
                left = before[i]
                if left >= 0:
                    new = get(data[left:end], -1)
                    if pair[left] != new:
                        pair[left] = new
                        if new >= 0:
                            entering.append((new, left))
                            lower = lower or new < rank
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        words = [self.pattern.findall(chunk) for chunk in chunks]
        ids = iter(self.merge_all([utf8(w) for ws in words for w in ws]))
        out = []
        for ws in words:
            own = next(ids) if len(ws) == 1 else [i for _ in ws for i in next(ids)]
            out.append(struct.pack(f"<{len(own)}I", *own))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_chunks([text])[0], "<u4").tolist() if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], tuple[Bpe, ChunkCache, list[str]]] = {}


def loaded(path: str, pattern: str) -> tuple[Bpe, ChunkCache, list[str]]:
    """The encoder, its chunk cache and the ids' decimal names, once a worker."""
    if (path, pattern) not in _loaded:
        bpe = Bpe(load_ranks(path), pattern)
        _loaded[path, pattern] = bpe, ChunkCache(bpe.encode_chunks, BYTE_BPE_CUT, lead=" ", remembered=MANY), [str(i) for i in range(max(bpe.tokens, default=0) + 1)]
    return _loaded[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, cache, names = loaded(path, pattern)
        for frame in slices(frames, most=1_000_000):
            counts, sums, back = [], [], []
            for data in cache(frame["text"].tolist()):
                ids = np.frombuffer(data, "<u4").tolist()
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": counts, "ids_sha256": sums, "decoded_sha256": back})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
