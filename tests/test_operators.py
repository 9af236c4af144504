"""Operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import sequence as S
from strandwise.operators import classify, correction, counting, profiles, truth
from strandwise.sources import sequence_files as files


def one(spark, column, **values):
    names = list(values)
    types = {str: "string", int: "int", float: "double", type(None): "string"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {types[type(values[n])]}" for n in names))
    return frame.select(column.alias("out")).first().out


def test_strands(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="AACGN") == "NCGTT"
    assert one(spark, S.complement(F.col("s")), s="AXN") == "TXN"
    assert one(spark, S.reverse_complement(F.col("s")), s=None) is None
    with pytest.raises(Exception, match="not a DNA string"):
        one(spark, S.reverse_complement(F.col("s"), strict=True), s="AXN")


def test_gc(spark):
    assert one(spark, S.gc_content(F.col("s")), s="") is None
    assert one(spark, S.gc_bin(F.col("s")), s="GGGAAAAAAAA") == 3
    assert one(spark, S.gc_bin(F.col("s"), compat=True), s="GGGAAAAAAAA") == 2
    assert S.minimum_k(7354) == 11


def test_errors(spark):
    kind = S.infer_error_type(F.col("a"), F.col("b"))
    assert [one(spark, kind, a="A", b=b) for b in ("", "C", "AG", "ACG")] == ["INSERTION", "SUB_FROM_C", "DEL_OF_G", "MULTIDEL"]
    undo = S.undo_error(F.col("s"), F.col("t"), F.lit(1))
    assert [one(spark, undo, s="ACG", t=t) for t in ("SUB_FROM_T", "INSERTION", "DEL_OF_A", "MULTIDEL")] == ["ATG", "AG", "ACAG", None]
    assert one(spark, S.correction_text(F.lit("INSERTION"), F.lit(3), F.col("a"), F.lit(""), F.lit(1.0)), a="A") == "INSERTION 3 A . 1.0"
    with pytest.raises(Exception, match="no such error type"):
        one(spark, S.error_number(F.col("t")), t="OTHER")
    scores = F.expr("array(struct(0.5D as score, 3 as number), struct(0.5D as score, 2 as number))")
    assert one(spark, S.most_likely(scores, "CORRECT"), a="A") == "SUB_FROM_A"
    assert one(spark, S.read_name(F.col("s")), s="r1/2 x") == "r1"


def test_md_tag(spark):
    out = one(spark, S.md_substitutions(F.col("s")), s="10A5^AC6T0G")
    assert [(r.base, r.position) for r in out] == [("A", 10), ("T", 22), ("G", 23)]


def test_palindromes_count_twice(spark):
    seqs = spark.createDataFrame([("ACGT",), ("AC",), ("",), (None,)], "seq string")
    assert {r.kmer: r.n for r in counting.count_both(seqs, 4).collect()} == {"ACGT": 2}
    assert counting.count_both(seqs.limit(0), 4).count() == 0


def test_fill_bias():
    assert counting.fill_bias([1, 0, 0, 1]) == [1, 0.5, 0.75, 1]
    assert counting.fill_bias([0, 0, 2, 0, 0, 0, 4, 0]) == [2, 2, 2, 1, 0.5, 2.25, 4, 4]
    assert counting.fill_bias([0.0, 0.0]) == [1.0, 1.0]


def test_coverage_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(counting, "TILE", 4)
    genome = spark.createDataFrame([(1, "ACGTACGTACGTACGT")], "contig long, seq string")
    spans = [(1, a, b) for a, b in ((0, 9), (3, 15), (5, 6), (5, 7), (14, 15))]
    found = {r.pos: r.obs for r in counting.covered(genome, spark.createDataFrame(spans, "contig long, first long, last long"), 3).collect()}
    assert found == {p: sum(a <= p and b >= p + 2 for _, a, b in spans) for p in range(14)}


def test_classes(spark):
    assert [one(spark, classify.naive(F.col("n"), F.lit(1.0), 10.0), n=n) for n in (4, 5, 14, 15)] == ["UNTRUSTED", "TRUSTED", "TRUSTED", "REPEAT"]
    assert [one(spark, classify.rule_naive(F.col("n"), F.lit(10.0)), n=n) for n in (4, 15, 16)] == [2, 1, 0]
    # At exactly half and one and a half of what is expected, whatever the sum's last digit.
    for e in (9.753680270398613, 9.753680270398615, 9.753680270398617, 9.75368027039862):
        for m in (10, 11, 17, 22):
            bias = F.lit(m / e)
            low, high = (F.lit(share * m) for share in (0.5, 1.5))
            found = F.concat_ws(" ", classify.rule_naive(low / bias, F.lit(e)), classify.rule_naive(high / bias, F.lit(e)), classify.naive(low, bias, e), classify.naive(high, bias, e))
            assert one(spark, found, n=0) == "1 1 TRUSTED REPEAT"


def test_alignments(spark):
    rows = [
        ("a", 0, 1, 2, "3S2M1I2M2D2M", "TTTGTAACGA"),
        ("b", 4, 1, 0, "2M", "TT"),
        ("c", 0, 1, 0, "2H2M", "TT"),
        ("d", 0, 1, 0, "2M", "TT"),
        ("d", 0, 1, 4, "2M", "TT"),
        ("e", 0, 1, 0, None, "TT"),
    ]
    genome = spark.createDataFrame([(1, "ACGTACGTACGT")], "contig long, seq string")
    found = truth.true_corrections(spark.createDataFrame(rows, "read_id string, flag int, contig long, begin_pos long, cigar string, seq string"), genome).collect()
    assert {(r.read_id, r.orig_pos, r.type) for r in found} == {("a", 5, "INSERTION"), ("a", 7, "MULTIDEL"), ("a", 8, "SUB_FROM_A"), ("a", 9, "SUB_FROM_C")} | {
        ("a", 3 + i, f"SUB_FROM_{g}") for i, (b, g) in enumerate(zip("GT", "GT")) if b != g
    }


def test_alignments_under_many_reads_and_long_ones(spark):
    """Tiles dealt as copies give each read the same stretch once; a long read and one past the contig's end are looked at whole."""
    rng = random.Random(3)
    text = "".join(rng.choices("ACGT", k=30_000))
    rows = [(f"r{i}", 0, "c", i % 50, "20M", text[i % 50 : i % 50 + 20]) for i in range(600)] + [("far", 0, "c", 9_000, "20M", text[9_000:9_020])]
    long = list(text[100:20_100])
    wrong = sorted(rng.sample(range(20_000), 40))
    for at in wrong:
        long[at] = "ACGT"["ACGT".index(long[at]) - 1]
    past = ("past", 0, "c", 29_990, "12M", text[29_990:] + "AC")
    schema = "read_id string, flag int, contig string, begin_pos long, cigar string, seq string"
    genome = spark.createDataFrame([("c", text), ("none", "")], "contig string, seq string")
    usable = truth.usable(spark.createDataFrame(rows, schema))
    met = truth.with_reference(usable, genome, least=64, deep=7)
    assert sorted((r.read_id, r.ref) for r in met.collect()) == sorted((r[0], r[5]) for r in rows)
    assert sorted(met.columns) == sorted([*usable.columns, "ref"])
    frame = spark.createDataFrame([("long", 0, "c", 100, "20000M", "".join(long)), past], schema)
    found = sorted((r.read_id, r.orig_pos, r.type) for r in truth.true_corrections(frame, genome).collect())
    assert found[:40] == [("long", at, f"SUB_FROM_{text[100 + at]}") for at in wrong] and [f[:2] for f in found[40:]] == [("past", 10), ("past", 11)]
    assert truth.true_corrections(frame.limit(0), genome).count() == 0


def test_confusion(spark):
    truths = spark.createDataFrame([(1, 3, "SUB_FROM_A")], "read_id long, orig_pos long, type string")
    said = spark.createDataFrame([(1, 3, "SUB_FROM_A"), (1, 5, "INSERTION")], truths.schema)
    table = {r.type: r for r in correction.confusion(truths, said, spark.createDataFrame([(1, "ACGTACGTAC")], "read_id long, seq string")).collect()}
    assert (table["SUB_FROM_A"].tp, table["INSERTION"].fp) == (1, 1) and table["INSERTION"].tn == 8 and table["DEL_OF_A"].tn == 7 and table["MULTIDEL"].tn == 0


def test_empty_profile(spark):
    none = spark.createDataFrame([], "read_id long, orig_pos long, type string")
    rows = profiles.overall(none, spark.createDataFrame([], "read_id long, seq string")).collect()
    assert len(rows) == 12 and all(r.log_p is None for r in rows)


def test_files(spark, tmp_path):
    path = tmp_path / "r.fastq"
    path.write_text("@a x\nACRT\n+\n@!!!\n@b/1 y\nAC_T\n+\n!!!!\n")
    assert {(r.read_id, r.seq, r.qual) for r in files.read_fastq(spark, str(path)).collect()} == {("a x", "ACNT", "@!!!"), ("b/1 y", "ACNT", "!!!!")}
    assert {(r.read_id, r.seq) for r in files.read_fastq(spark, str(path), gaps=True).collect()} == {("@a", "ACNT"), ("@b", "AC_T")}
    files.write_fastq(files.read_fastq(spark, str(path)), str(tmp_path / "out"))
    assert files.read_fastq(spark, str(tmp_path / "out")).count() == 2
    fasta = tmp_path / "g.fasta"
    fasta.write_text(">one\nACG\ntt\n>two\nGG\n")
    assert {(r.contig, r.seq) for r in files.read_fasta(spark, str(fasta)).collect()} == {("one", "ACGTT"), ("two", "GG")}
    assert [r.contig for r in files.read_fasta(spark, str(fasta), first_only=True).collect()] == ["one"]
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1\nr\t16\tone\t3\t60\t2M\t*\t0\t0\tGT\t!!\tMD:Z:2\n")
    row = files.read_sam(spark, str(sam)).first()
    assert (row.read_id, row.flag, row.begin_pos, row.cigar, row.md) == ("r", 16, 2, "2M", "2")
