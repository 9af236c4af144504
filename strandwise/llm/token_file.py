"""Token ids in fixed-width binary files.

A file holds, in order: MAGIC; blocks of BLOCK ids, each id in the least number of bits that the
vocabulary needs, least significant bit first, each block padded to whole bytes; then an index
(document ids, null marks, document starts, byte offset of each block) and a trailer with the index's
place, the width and the counts. Blocks are unpacked with vectorised numpy; ids [a, b) need only the
blocks that hold them, found by the offsets.

Documents are written in ascending doc_id (null: smallest; equal ones by their text), null
texts as empty ones; each document ends with the end id. Each range of doc_id is a file, named after
the range and put in place by a rename, so that a task that runs again writes the same file again.
The folder is the cluster's shared one, reached through pyarrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import MANY, in_order, library_cache
from strandwise.session import shared_path, written

MAGIC = b"FWTOKEN1"
BLOCK = 65536
TRAILER = struct.Struct("<QQQQI")


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as width-bit fields, least significant bit first, padded with zeros to whole bytes."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class TokenWriter:
    """Writes documents one after another; memory holds one block and the index."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.docs: list[int | None] = []
        self.starts, self.offsets, self.waiting, self.held = [0], [len(MAGIC)], [], 0
        stream.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.stream.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError("an id needs more bits than the file's width")
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._put(ids[at : at + BLOCK])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        index = docs.tobytes() + null.tobytes() + np.array(self.starts, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes()
        self.stream.write(index)
        self.stream.write(TRAILER.pack(self.offsets[-1], len(self.docs), self.starts[-1], len(self.offsets) - 1, self.width) + MAGIC)


class TokenReader:
    """Random access to a file's ids through any seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - TRAILER.size - len(MAGIC))
        tail = stream.read(TRAILER.size + len(MAGIC))
        if tail[TRAILER.size :] != MAGIC:
            raise ValueError("not a token file, or cut short")
        at, self.n_docs, self.n_ids, n_blocks, self.width = TRAILER.unpack(tail[: TRAILER.size])
        stream.seek(at)
        index = stream.read(size - at - TRAILER.size - len(MAGIC))
        self.docs = np.frombuffer(index, "<i8", self.n_docs)
        self.null = np.frombuffer(index, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.starts = np.frombuffer(index, "<i8", self.n_docs + 1, 9 * self.n_docs)
        self.offsets = np.frombuffer(index, "<i8", n_blocks + 1, 17 * self.n_docs + 8)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end) of the file; reads only the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        self.stream.seek(int(self.offsets[first]))
        data = self.stream.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            lo, hi = (int(self.offsets[x] - self.offsets[first]) for x in (b, b + 1))
            parts.append(unpack(data[lo:hi], min(BLOCK, self.n_ids - b * BLOCK), self.width))
        return np.concatenate(parts)[begin - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Encode every document, write the files, and return the manifest: part, path, n_docs, n_ids, base.

    base counts the ids of all files before; there is one row a file.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    ordered, _ = in_order(docs)
    width = width_of(vocabulary)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = library_cache(tokenizer, words=True, remembered=MANY)
        end = np.array([end_id], "<u4").tobytes()
        writer = stream = system = None
        part, target, own = 0, "", ""
        for frame in frames:
            at = 0
            all_texts, doc_ids = frame["text"].tolist(), frame["doc_id"].tolist()
            while at < len(frame):
                texts, held = [], 0
                begin = at
                while at < len(frame) and held < 1_000_000:
                    texts.append(all_texts[at])
                    held += len(texts[-1])
                    at += 1
                if writer is None:
                    part = int(frame["part"].iat[0])
                    system, root = _file_system(folder)
                    system.create_dir(root, recursive=True)
                    target, own = f"{root}/part-{part:06d}.tok", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(own)
                    writer = TokenWriter(stream, width)
                for i, ids in enumerate(encode(texts), begin):
                    doc_id = doc_ids[i]
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            system.move(own, target)
            yield pd.DataFrame({"part": [part], "path": [f"{folder}/part-{part:06d}.tok"], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]})

    manifest = written(ordered.mapInPandas(write, "part int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Each document's place and ids' checksum as the files hold them."""
    n = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                system, path = _file_system(row.path)
                with system.open_input_file(path) as stream:
                    tokens = TokenReader(stream)
                    i = 0
                    while i < tokens.n_docs:
                        j = max(i + 1, int(np.searchsorted(tokens.starts, tokens.starts[i] + 1_000_000, side="right")) - 1)
                        j = min(j, tokens.n_docs)
                        ids = tokens.ids(int(tokens.starts[i]), int(tokens.starts[j])).astype("<u4")
                        at = tokens.starts[i : j + 1] - tokens.starts[i]
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array(np.where(tokens.null[i:j], None, tokens.docs[i:j].astype(object)), dtype="Int64"),
                                "start": tokens.starts[i:j] + row.base,
                                "n_tokens": np.diff(at),
                                "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])],
                            }
                        )
                        i = j

    return manifest.repartition(n, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
