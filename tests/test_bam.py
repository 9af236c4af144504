"""A BAM file put together by hand, and stores."""

import gzip
import random
import struct
import zlib

import pytest

from strandwise.sources import alignment_files, stores


def packed(name, flag, contig, pos, cigar, seq, qual, tags):
    codes = [alignment_files.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    steps = b"".join(struct.pack("<I", n << 4 | alignment_files.STEPS.index(op)) for n, op in cigar)
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + steps + bases + qual + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 4) + b"one\0" + struct.pack("<i", 100)
    tags = b"NMi" + struct.pack("<i", 1) + b"XBBc" + struct.pack("<i", 2) + b"\1\2" + b"MDZ3A1\0"
    rows = packed("r1", 16, 0, 7, [(2, "S"), (3, "M")], "ACGTN", bytes([0, 10, 20, 30, 40]), tags) + packed("r2", 4, -1, -1, [], "AC", b"\xff\xff", b"")
    data = head + rows
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]) + gzip.compress(b""))
    found = [tuple(r) for r in alignment_files.read_bam(spark, str(tmp_path / "a.bam")).orderBy("line").collect()]
    assert found == [(0, "r1", 16, "one", 7, "2S3M", "ACGTN", "!+5?I", "3A1"), (1, "r2", 4, "*", -1, "*", "AC", "", None)]


def blocked(data, size):
    """Data as the format's blocks of so many plain bytes, and the empty one at the end."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += alignment_files.BLOCK_HEAD + alignment_files.BEFORE_SIZE + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def made(seed, n, longest):
    """A file's plain bytes, and its rows."""
    rng = random.Random(seed)
    contigs = [f"contig{i}" for i in range(40)]
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 40)
    head += b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 9) for c in contigs)
    data, rows = [head], []
    for line in range(n):
        size = rng.choice((0, 1, 30, 31, rng.randint(1, longest)))
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = bytes(rng.randint(0, 60) for _ in seq)
        steps = [(2, "S"), (size - 2, "M")] if size > 2 else []
        contig = rng.randint(-1, 39)
        md = f"{size}A0" if rng.random() < 0.5 else None
        tags = b"NMi" + struct.pack("<i", 0) + (b"MDZ" + md.encode() + b"\0" if md else b"")
        stored, shown = steps, steps
        if size > 100 and rng.random() < 0.3:  # more steps than a record's own field takes
            shown = [(2, "S")] + [(1, "MD"[i % 2]) for i in range(2 * (size - 2) - 1)]
            stored = [(size, "S"), (size, "N")]
            tags += b"CGBI" + struct.pack("<i", len(shown)) + b"".join(struct.pack("<I", a << 4 | alignment_files.STEPS.index(op)) for a, op in shown)
        data.append(packed(f"read/{line}", 16 * (line % 2), contig, line - 1, stored, seq, qual, tags))
        cigar = "".join(f"{a}{op}" for a, op in shown) or "*"
        rows.append((line, f"read/{line}", 16 * (line % 2), contigs[contig] if contig >= 0 else "*", line - 1, cigar, seq, "".join(chr(33 + q) for q in qual), md))
    return b"".join(data), rows


@pytest.fixture
def split(spark):
    """Splits of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("n,longest,block,size", [(3000, 300, 4000, 20_000), (200, 5000, 700, 3000), (1500, 200, 65_000, 1 << 27), (40, 60_000, 9000, 5000), (0, 1, 100, 300)])
def test_a_file_in_several_tasks(spark, tmp_path, split, n, longest, block, size):
    """Records across blocks, records across several splits, a header over several splits, one task, no records."""
    data, rows = made(n, n, longest)
    (tmp_path / "a.bam").write_bytes(blocked(data, block))
    split(size)
    found = alignment_files.read_bam(spark, str(tmp_path / "a.bam"))
    assert [tuple(r) for r in found.orderBy("line").collect()] == rows


def test_several_files_and_an_empty_one(spark, tmp_path, split):
    wanted = []
    for seed in range(3):
        data, rows = made(seed, 400, 100)
        (tmp_path / f"{seed}.bam").write_bytes(blocked(data, 3000))
        wanted += rows
    (tmp_path / "none.bam").write_bytes(b"")
    split(10_000)
    assert sorted(map(tuple, alignment_files.read_bam(spark, str(tmp_path)).collect()), key=str) == sorted(wanted, key=str)


def test_the_separator_within_a_block():
    body = b"x" + alignment_files.BEFORE_SIZE + b"y"
    stored = b"\1" + struct.pack("<HH", len(body), 65_535 - len(body)) + body  # not compressed
    line = struct.pack("<H", len(stored) + 25) + stored + struct.pack("<II", zlib.crc32(body), len(body))
    lines = [alignment_files.BLOCK_HEAD, *line.split(alignment_files.BEFORE_SIZE)]
    assert len(lines) == 3 and list(alignment_files.blocks(lines, True)) == [body]


@pytest.mark.parametrize("harm", [lambda b: b[:-60], lambda b: b[:2000] + b"zz" + b[2002:], lambda b: b"no" + b])
def test_damaged_files_raise(spark, tmp_path, split, harm):
    data, _ = made(1, 300, 100)
    (tmp_path / "a.bam").write_bytes(harm(blocked(data, 3000)))
    split(10_000)
    with pytest.raises(Exception, match="ends within|damaged|not a BAM|invalid|incomplete"):
        alignment_files.read_bam(spark, str(tmp_path / "a.bam")).collect()


def test_stores(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", 1)], "x string, y int")

    assert stores.stored(spark, f"{tmp_path}/s", make).collect() == stores.stored(spark, f"{tmp_path}/s", make).collect() and len(made) == 1
