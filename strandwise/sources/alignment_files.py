"""BAM files as the same rows as SAM files, read in as many tasks as Spark splits a file into.

A BAM file is a chain of small gzip blocks, each with the same bytes before its size. Spark's text source takes those
bytes as the line separator, so that it reads, splits and prunes files as it does any other, wherever they are, and
each line is one block. A task unpacks the blocks of its split as a stream and looks for the first place from which
records follow each other. What lies before it and what is left at the end goes out as pieces; the few pieces of a file
are put together in order and read as what they must be, whole records (the first: the header), and if one is not,
a split was entered at a wrong place and an error is raised: rows are never wrong. The parsed records are written once
to the shared folder.

Defined cases: an empty or header-only file gives no rows; missing bases and qualities are empty strings; records may
be longer than blocks and splits; steps that don't fit into a record are taken from its CG tag; files of gzip members
without sizes are one line, so one task reads them; a damaged or truncated file raises an error.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.session import written

# Fixed values of the format: letters of bases and of cigar steps by their codes, the bytes before and at a block's size.
BASES, STEPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
BLOCK_HEAD, BEFORE_SIZE = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"\x06\0BC\x02\0"
#: A record's fixed part: size, contig, place, length of name, steps, flag and bases.
FIXED = struct.Struct("<iiiBxxxHHiiii")
#: Bytes that a tag's value takes, by its type.
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Steps that take bases of the read.
OF_READ = frozenset("MIS=X")
#: Unpacked bytes a frame, and records that must follow each other where a split is entered.
AT_ONCE, CHAIN = 4_000_000, 16
#: Numbers of records that are put together come behind those of the split in which they begin.
BEHIND = 2**40
#: Kinds of rows: bytes before a split's first record, records, bytes after its last one, contigs.
HEAD, RECORD, TAIL, CONTIG = range(4)
NAMES = ["read_id", "flag", "contig_id", "begin_pos", "cigar", "seq", "qual", "md"]
SCHEMA = "file string, start long, kind int, at long, bytes binary, read_id string, flag int, contig_id int, begin_pos long, cigar string, seq string, qual string, md string"
#: The letters of both bases of each packed byte.
PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a file of consecutive gzip members."""
    while data:
        stream = zlib.decompressobj(31)
        yield stream.decompress(data)
        if not stream.eof:
            raise ValueError("the file ends within a block")
        data = stream.unused_data


def blocks(lines: Iterable[bytes], first: bool) -> Iterator[bytes]:
    """The plain bytes of each block of a split; a line is a block from its size on and the first bytes of the next one."""
    lines = iter(lines)
    if first:
        line = next(lines)
        if line[:2] != BLOCK_HEAD[:2]:
            raise ValueError("not a BAM file")
        if len(line) != len(BLOCK_HEAD):
            yield from unpacked(BEFORE_SIZE.join([line, *lines]))
            return
    held = b""
    for line in lines:
        held = held + BEFORE_SIZE + line if held else line
        size = int.from_bytes(held[:2], "little") - 15
        if len(held) < size:
            continue  # the separator's bytes, met within a block
        data = zlib.decompress(held[2 : size - 8], -15)
        if len(held) not in (size, size + len(BLOCK_HEAD)) or zlib.crc32(data) != int.from_bytes(held[size - 8 : size - 4], "little"):
            raise ValueError("a block is damaged")
        yield data
        held = b""
    if held:
        raise ValueError("the file ends within a block")


def header(data: bytes) -> tuple[int, list[str]] | None:
    """The header's length and contigs; None if it doesn't end within data."""
    try:
        if data[:4] != b"BAM\1"[: len(data)]:
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        contigs = []
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            contigs.append(bytes(data[at + 4 : at + 3 + size]).decode())
            at += 8 + size
    except struct.error:
        return None
    return (at, contigs) if at <= len(data) else None


def follows(data: bytes, at: int) -> int | None:
    """Where the record at this place ends, which may be behind data; None if there can't be one."""
    n, contig, pos, name_size, steps, _, size, other, other_pos, _ = FIXED.unpack_from(data, at)
    if min(contig, pos, other, other_pos) < -1 or name_size < 1 or size < 0 or 32 + name_size + 4 * steps + (size + 1) // 2 + size > n:
        return None
    name = data[at + 36 : at + 36 + name_size]
    if not all(33 <= c <= 126 for c in name[: name_size - 1]) or (len(name) == name_size and name[-1]):
        return None
    if steps and at + 36 + name_size + 4 * steps <= len(data):
        taken = struct.unpack_from(f"<{steps}I", data, at + 36 + name_size)
        if any(x & 15 >= len(STEPS) for x in taken) or (size and sum(x >> 4 for x in taken if STEPS[x & 15] in OF_READ) != size):
            return None
    return at + 4 + n


def entered(data: bytes, ended: bool) -> int | None:
    """The first place from which records follow each other; None if there is none or more bytes must tell."""
    whole = np.frombuffer(data, np.uint8)
    n = len(whole) - FIXED.size + 1
    if n <= 0:
        return None
    # A record is not longer than a gigabyte, and its contig, place and number of bases are small or minus one.
    sizes = whole[3 : 3 + n] < 64
    signs = [(whole[k : k + n] < 128) | (whole[k : k + n] == 255) for k in (7, 11, 27, 31)]
    for at in np.flatnonzero(sizes & np.logical_and.reduce(signs) & (whole[23 : 23 + n] < 128) & (whole[12 : 12 + n] > 0)):
        here, seen = int(at), 0
        while seen < CHAIN and here + FIXED.size <= len(data):
            end = follows(data, here)
            if end is None:
                seen = -1
                break
            if end > len(data):
                break
            here, seen = end, seen + 1
        if seen == CHAIN or (seen > 0 and ended):
            return int(at)
        if seen >= 0 and not ended:
            return None
    return None


def tags_of(data: bytes) -> tuple[str | None, tuple[int, ...] | None]:
    """The MD tag and the steps of the CG tag."""
    md, long, at = None, None, 0
    while at < len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if name == b"MD":
                md = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            if name == b"CG" and of == "I":
                long = struct.unpack_from(f"<{n}I", data, at + 5)
            at += 5 + n * SIZES[of]
        else:
            at += SIZES[kind]
    return md, long


def records(data: bytes) -> tuple[pd.DataFrame, int]:
    """The whole records from the start of data on, and where they end."""
    plain = np.frombuffer(data, np.uint8)
    letters, quals = PAIRS[plain].tobytes(), (plain + 33).tobytes()
    rows, at = [], 0
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        if end > len(data):
            break
        if end - at < FIXED.size or follows(data, at) is None:
            raise ValueError("a record is damaged, or a split was entered where none begins")
        _, contig, pos, name_size, steps, flag, size, *_ = FIXED.unpack_from(data, at)
        at += FIXED.size
        name = data[at : at + name_size - 1].decode()
        at += name_size
        taken = struct.unpack_from(f"<{steps}I", data, at)
        at += 4 * steps
        seq = letters[2 * at : 2 * at + size].decode()
        at += (size + 1) // 2
        qual = "" if data[at : at + 1] == b"\xff" else quals[at : at + size].decode()
        md, long = tags_of(data[at + size : end])
        if long is not None and steps == 2 and taken[0] == size << 4 | STEPS.index("S"):
            taken = long
        cigar = "".join(f"{x >> 4}{STEPS[x & 15]}" for x in taken)
        rows.append((name, flag, contig, pos, cigar or "*", seq, qual if size else "", md))
        at = end
    return pd.DataFrame(rows, columns=NAMES), at


def piece(kind: int, at: int, data: bytes) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind], "at": [at], "bytes": [bytes(data)]})


def numbered(rows: pd.DataFrame, before: int) -> pd.DataFrame:
    return rows.assign(kind=RECORD, at=np.arange(before, before + len(rows)))


def parsed(plain: Iterator[bytes], first: bool) -> Iterator[pd.DataFrame]:
    """A split's records, between the bytes before and after them; only the former if no record is found."""
    data, asked, at = b"", 1, None
    gathered: list[bytes] = []
    for block in plain:
        gathered.append(block)
        if sum(map(len, gathered)) < asked:
            continue
        data, gathered = data + b"".join(gathered), []
        found = header(data) if first else entered(data, False)
        at = found[0] if first and found else None if first else found
        if at is not None:
            break
        asked = len(data)  # ask again when there is twice as much
    data, gathered = data + b"".join(gathered), []
    if at is None and not first:
        at = entered(data, True)
    elif at is None and (found := header(data)):
        at = found[0]
    yield piece(HEAD, 0, data if at is None else data[:at])
    if at is None:
        return
    data, n = data[at:], 0
    for block in itertools.chain(plain, [None]):
        if block is not None:
            gathered.append(block)
            if len(gathered) * 65_536 < AT_ONCE:
                continue
        data, gathered = data + b"".join(gathered), []
        rows, end = records(data)
        yield numbered(rows, n)
        data, n = data[end:], n + len(rows)
    yield piece(TAIL, 0, data)


def shaped(rows: pd.DataFrame, **same: object) -> pd.DataFrame:
    """All columns of SCHEMA, those of a table without them null."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    missing = {c: None for c in columns if c not in rows and c not in same}
    return rows.assign(**same, **missing)[columns]


def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lines = (row for f in frames for row in zip(f["file"], f["start"], f["value"]))
    for (file, start), rows in itertools.groupby(lines, key=lambda row: row[:2]):
        for out in parsed(blocks((bytes(r[2]) for r in rows), start == 0), start == 0):
            yield shaped(out, file=file, start=start)


def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of the pieces between two splits; the header's contigs of the first pieces of a file."""
    for frame in frames:
        for file, start, group, pieces in zip(frame["file"], frame["start"], frame["group"], frame["pieces"]):
            data, found = b"".join(bytes(p["bytes"]) for p in pieces), []
            if group == 0:
                read = header(data)
                if read is None:
                    raise ValueError("the file ends within its header")
                data = data[read[0] :]
                found.append(pd.DataFrame({"kind": CONTIG, "contig_id": range(len(read[1])), "read_id": read[1]}))
            rows, end = records(data)
            if end != len(data):
                raise ValueError("the file ends within a record, or a split was entered where none begins")
            found.append(numbered(rows, BEHIND))
            for out in found:
                yield shaped(out, file=file, start=start if group else -1)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, within a file), read_id, flag, contig, begin_pos (from 0), cigar, seq, qual and md of each record."""
    lines = spark.read.option("lineSep", BEFORE_SIZE.decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = written(lines.mapInPandas(parse, SCHEMA), "bam-splits")
    order = Window.partitionBy("file").orderBy("start", "kind")
    pieces = found.where(F.col("kind") != RECORD).withColumn("group", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    groups = pieces.groupBy("file", "group").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("pieces"))
    between = written(groups.select("file", "start", "group", "pieces").mapInPandas(together, SCHEMA), "bam-borders")
    rows = found.where(F.col("kind") == RECORD).unionByName(between.where(F.col("kind") == RECORD))
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.sum((F.col("at") < BEHIND).cast("long")).alias("own"))
    before = counts.select("file", "start", "own", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    contigs = between.where(F.col("kind") == CONTIG).select("file", "contig_id", F.col("read_id").alias("contig"))
    line = F.col("before") + F.when(F.col("at") < BEHIND, F.col("at")).otherwise(F.col("at") - BEHIND + F.col("own"))
    rows = rows.join(before, ["file", "start"]).join(contigs, ["file", "contig_id"], "left")
    return rows.select(line.alias("line"), "read_id", "flag", F.coalesce("contig", F.lit("*")).alias("contig"), "begin_pos", "cigar", "seq", "qual", "md")
