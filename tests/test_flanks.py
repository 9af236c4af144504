"""Work at places on parts of reads gives what whole reads give."""

import random
from itertools import product

import pytest

from strandwise.functions.sequence import ERROR_TYPES
from strandwise.operators import correction, counting, flanks, profiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = []
    for i in range(40):
        n = rng.choice([1, 5, 7, 8, 14, 30, 60, 90])
        a = rng.randrange(len(genome) - n)
        s = list(genome[a : a + n])
        for p in range(rng.randrange(1, 9), n, 19):
            s[p] = rng.choice(["A", "C", "G", "T", "", s[p] + "A"])
        reads.append((i, "".join(s)))
    reads += [(100, ""), (101, None)]
    return reads, spark.createDataFrame([(1, genome)], "contig long, seq string"), spark.createDataFrame(reads, "read_id long, seq string")


@pytest.mark.parametrize("span", [1, 7, 256])
def test_flanks_hold_the_bases_around(spark, rows, monkeypatch, span):
    monkeypatch.setattr(flanks, "SPAN", span)
    reads, _, frame = rows
    at = profiles.places(frame).select("read_id", "orig_pos")
    got = {(r.read_id, r.orig_pos): (r.size, r.place, r.flank) for r in flanks.flanked(at, frame, 4, 6).collect()}
    assert got == {(i, p): (len(s), min(p, 4), s[max(0, p - 4) : p + 7]) for i, s in reads for p in range(len(s or ""))}


def test_short_pieces_change_nothing(spark, rows, monkeypatch):
    _, genome, frame = rows
    known = counting.count_both(genome, 9).cache()
    rates = spark.createDataFrame([(t, -float(n)) for n, t in enumerate(ERROR_TYPES)], "type string, log_p double")
    matrix = spark.createDataFrame([(a, b, 3) for a in "ACGT" for b in "ACGT" if a != b], "read_base string, true_base string, n long")
    rng = random.Random(2)
    z = [("".join(m), pos, t, rng.uniform(-9, 9)) for k in (1, 2, 6) for m in product("ACGT", repeat=k) if k < 6 or rng.random() < 0.2 for pos in range(k) for t in profiles.SCORED if rng.random() < 0.3]
    motifs = profiles.MotifProfile(spark.createDataFrame(z, "motif string, pos int, type string, z double").cache())
    overall = profiles.OverallProfile(rates, matrix, 1000)

    def everything():
        fixed = correction.by_kmers(frame, known, 9)
        scores = [p.read_scores(frame, *span) for p in (overall, motifs) for span in ((0, None), (3, 20))]
        return [sorted(map(tuple, df.select(*columns).collect()), key=str) for df, columns in [(fixed, ["read_id", "orig_pos", "type"]), *[(s, ["read_id", "orig_pos", "type", "score"]) for s in scores]]]

    whole = everything()
    monkeypatch.setattr(flanks, "SPAN", 7)
    assert everything() == whole and all(whole)
    monkeypatch.setattr(profiles.MotifProfile, "reach", None)
    assert everything()[3:] == whole[3:]
