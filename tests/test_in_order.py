"""Correction in reading order and closing of gaps against plain loops over single reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import correction, counting, gaps, in_order

K, BEFORE = 5, correction.BEFORE
KINDS = ["INSERTION", *(f"SUB_FROM_{b}" for b in "ACGT"), *(f"DEL_OF_{b}" for b in "ACGT")]


def other(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def undone(s, kind, pos):
    if kind.startswith("SUB"):
        return s[:pos] + kind[-1] + s[pos + 1 :]
    return s[:pos] + s[pos + 1 :] if kind == "INSERTION" else s[: pos + 1] + kind[-1] + s[pos + 1 :]


def possible(s, pos):
    return [t for t in KINDS if not (t.startswith("SUB") and t[-1] == s[pos]) and (t.startswith("SUB") or pos < len(s) - 1)]


def mended(s, known, indels):
    """Corrections of one read from left to right, and the read after them."""
    out, at, pos, n = [], 0, 0, len(s)
    while pos < n and len(s) >= K:
        if s[min(at, len(s) - K) :][:K] not in known:
            hold = []
            for t in possible(s, at):
                m = undone(s, t, at)
                places = [max(0, min(at - back, len(m) - K)) for back in (0, BEFORE)]
                if len(m) >= K and all(m[p : p + K] in known for p in places) and (indels or t.startswith("SUB")):
                    hold.append(t)
            if len(hold) == 1:
                out.append((pos, hold[0]))
                s = undone(s, hold[0], at)
                at += -1 if hold[0] == "INSERTION" else 1 if hold[0].startswith("DEL") else 0
        at, pos = at + 1, pos + 1
    return out, s


def damaged(rng, s, rate):
    r = []
    for base in s:
        what = rng.random()
        if what < rate:
            r.append(rng.choice("ACGT"))
        elif what < 1.6 * rate:
            r += [base, rng.choice("ACGT")]
        elif what > 0.6 * rate + 1.6 * rate:
            r.append(base)
    return "".join(r)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(130))
    reads = [(i, damaged(rng, genome[at : at + size], rate)) for i, (at, size, rate) in enumerate((rng.randrange(90), rng.choice((12, 25, 40)), rng.choice((0.03, 0.1, 0.2))) for _ in range(400))]
    reads += [(1000, "ACG"), (1001, ""), (1002, None), (1003, genome), (1004, damaged(rng, genome, 0.1))]
    known = {w for s in (genome, other(genome)) for i in range(len(s) - K + 1) for w in [s[i : i + K]]}
    table = counting.count_both(spark.createDataFrame([(1, genome)], "contig long, seq string"), K)
    return dict(reads), spark.createDataFrame(reads, "read_id long, seq string").coalesce(2), known, table


@pytest.mark.parametrize("indels", [True, False])
def test_in_order(world, indels):
    reads, frame, known, table = world
    plain = {i: mended(s, known, indels) for i, s in reads.items() if s}
    expected = {(i, p, t) for i, (fixes, _) in plain.items() for p, t in fixes}
    found = in_order.by_kmers(frame, table, K, indels)
    assert found.dtypes == [("read_id", "bigint"), ("orig_pos", "bigint"), ("type", "string")]
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    at_once = {tuple(r) for r in correction.by_kmers(frame, table, K, indels).select("read_id", "orig_pos", "type").collect()}
    assert at_once != expected and len({i for i, fixes in plain.items() if len(fixes[0]) > 2}) > 5
    texts = {r.read_id: r.corrected for r in correction.apply(frame, found).collect()}
    assert {i: texts[i] for i in plain} == {i: s for i, (_, s) in plain.items()}


def test_stretches_are_the_size_of_their_places(world):
    _, frame, _, table = world
    rows = in_order.stretches(frame, table.select("kmer").distinct(), K).collect()
    assert len(rows) > len({r.read_id for r in rows})
    for r in rows:
        assert r.places == sorted(r.places) and len(r.text) <= r.places[-1] - r.places[0] + 2 * K + BEFORE + 3
        assert all(b - a <= BEFORE or r.size - 1 - a <= K for a, b in zip(r.places, r.places[1:]))


def test_nothing_to_mend(spark, world):
    _, frame, _, table = world
    assert in_order.by_kmers(frame.where("read_id < 0"), table, K).count() == 0
    assert in_order.by_kmers(frame, table.where("n < 0"), K).count() == 0
    assert in_order.by_kmers(frame.where("read_id = 1003"), table, K).count() == 0


def filling(before, behind, known, k, longest):
    """(fill, ways) of one gap: all strings, the shortest first."""
    texts = [before]
    for size in range(longest + 1):
        hold = []
        for t in texts:
            whole = t + behind
            if all(whole[i : i + k] in known for i in range(len(whole) - k + 1)):
                hold.append(t[k - 1 :])
        if hold:
            return (hold[0], 1) if len(hold) == 1 else (None, 2)
        texts = [t + b for t in texts for b in "ACGT" if (t + b)[-k:] in known]
    return None, 0


def test_gaps(spark):
    k, longest, rng = 6, 7, random.Random(11)
    unit = "".join(rng.choice("ACGT") for _ in range(9))
    piece = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    # The same ends around two different middles of one length: which one is missing can't be told.
    genome = piece(60) + unit + "ACC" + unit[::-1] + piece(40) + unit + "TGA" + unit[::-1] + piece(60)
    known = {w for s in (genome, other(genome)) for i in range(len(s) - k + 1) for w in [s[i : i + k]]}
    table = counting.count_both(spark.createDataFrame([(1, genome)], "contig long, seq string"), k)
    reads = [(i, genome[at : at + 14] + "_" + genome[at + 14 + n :][:14]) for i, (at, n) in enumerate((at, at % 10) for at in range(len(genome) - 40))]
    both = genome[:20] + "_" + genome[23:40] + "_" + genome[44:60]
    close = genome[:20] + "_" + genome[23:25] + "_" + genome[28:50]
    reads += [(900, both), (901, close), (902, "_"), (903, "ACGTACGT_"), (904, None), (905, ""), (906, genome[:50]), (907, "AAAAAAAAA_CCCCCCCCC")]
    reads += [(908, unit + "_" + unit[::-1])]
    frame = spark.createDataFrame(reads, "read_id long, seq string").withColumn("fills", F.lit(1)).drop("fills")
    expected = {}
    for i, s in reads:
        for p, base in enumerate(s or ""):
            if base == "_":
                before, behind = s[max(0, p - k + 1) : p], s[p + 1 :][: k - 1]
                whole = len(before) == len(behind) == k - 1 and "_" not in before + behind
                expected[i, p] = filling(before, behind, known, k, longest) if whole else (None, 0)
    fills = gaps.closed(frame, table, k, longest)
    assert {(r.read_id, r.orig_pos): (r.fill, r.ways) for r in fills.collect()} == expected
    assert {w for _, w in expected.values()} == {0, 1, 2} and len({len(f) for f, _ in expected.values() if f is not None}) > 5
    texts = {r.read_id: r.corrected for r in gaps.filled(frame, fills).collect()}
    for i, s in reads:
        out = "".join((expected[i, p][0] if expected[i, p][0] is not None else "_") if base == "_" else base for p, base in enumerate(s or ""))
        assert texts[i] == (None if s is None else out)
    assert texts[900] == genome[:60] and texts[901].count("_") == 2
