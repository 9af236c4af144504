"""Suffix ranks against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import suffixes


def other(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made(seed, unit, copies):
    rng = random.Random(seed)
    repeat = "".join(rng.choice("ACGT") for _ in range(unit))
    part = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    first = part(60) + repeat + part(30) + other(repeat) + part(25)
    genome = [(1, first), (2, part(80) + "A" * 50 + repeat[: unit // 2]), (3, "ACGT"), (4, ""), (5, None), (6, first[:70]), (7, "ACGTNNNNN" + part(10))]
    reads = [(i, g[a : a + n]) for i in range(copies) for g in [rng.choice([x for _, x in genome if x])] for n in [rng.randint(1, 130)] for a in [rng.randrange(len(g))]]
    reads = [(i, s if rng.random() < 0.5 else s[: len(s) // 2] + "C" + s[len(s) // 2 :]) for i, s in reads]
    return genome, [*reads, (1000, ""), (1001, None), (1002, "N_N")]


def counts(genome):
    found = {}
    for _, g in genome:
        for s in (g or "", other(g or "")):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    found[s[a:b]] = found.get(s[a:b], 0) + 1
    return found


def longest(s, pos, found, least):
    n = 0
    while pos + n < len(s) and found.get(s[pos : pos + n + 1], 0) >= least:
        n += 1
    return n


@pytest.fixture(scope="module", params=[(3, 50), (4, 100)])
def world(request, spark):
    genome, reads = made(request.param[0], request.param[1], 60)
    frames = spark.createDataFrame(genome, "contig long, seq string"), spark.createDataFrame(reads, "read_id long, seq string")
    return genome, reads, counts(genome), *frames


def test_lengths_of_matches(world):
    genome, reads, found, genome_rows, read_rows = world
    got = {(r.of_genome, r.id, r.pos): (r.once, r.twice) for r in suffixes.matches(genome_rows, read_rows).collect()}
    expected = {(False, i, p): (longest(s, p, found, 1), longest(s, p, found, 2)) for i, s in reads for p in range(len(s or ""))}
    expected |= {(True, i, p): (longest(s, p, found, 2), longest(s, p, found, 3)) for i, s in genome for p in range(len(s or ""))}
    assert got == expected


def test_shortest_unique_windows(world):
    genome, _, found, genome_rows, _ = world
    got = {(r.contig, r.pos): r.n for r in suffixes.unique_windows(genome_rows).collect()}
    assert got == {(i, p): next((n for n in range(1, len(s) - p + 1, 2) if found[s[p : p + n]] == 1), None) for i, s in genome for p in range(len(s or ""))}


def test_starts_grow_without_a_bound(world):
    _, reads, found, genome_rows, read_rows = world
    k, expected = 11, {}
    for i, s in reads:
        for p in range(len(s or "") - k + 1):
            reach = p + k + 2 * ((len(s) - p - k) // 2)
            windows = [(p, e) for e in range(p + k, reach + 1, 2)] + [(a, reach) for a in range(p - 2, -1, -2)]
            kinds = [(found.get(s[a:b], 0), b - a) for a, b in windows]
            expected[i, p] = next((("UNTRUSTED" if c == 0 else "TRUSTED", n) for c, n in kinds if c < 2), ("REPEAT", None))
    got = {(r.read_id, r.start): (r["class"], r.n) for r in suffixes.grown_starts(genome_rows, read_rows, k).collect()}
    assert got == expected
    assert max(n for _, n in got.values() if n) > 21


def test_keys_of_one_rank_may_be_spread(spark):
    rows = [(r, key) for r, n in ((0, 400), (400, 3)) for key in range(n)] + [(0, 7)] * 5
    got = {(r["rank"], r.key): (r.new, r.same) for r in suffixes.ranked(spark.createDataFrame(rows, "rank long, key long")).collect()}
    assert got == {(r, k): (r + k + (5 if r == 0 and k > 7 else 0), 6 if (r, k) == (0, 7) else 1) for r, k in set(rows)}


def test_empty_tables(spark):
    genome, reads = spark.createDataFrame([], "contig long, seq string"), spark.createDataFrame([(1, "ACGTACGTACGTA")], "read_id long, seq string")
    assert suffixes.unique_windows(genome).collect() == []
    assert {r["class"] for r in suffixes.grown_starts(genome, reads, 11).collect()} == {"UNTRUSTED"}
    assert suffixes.matches(genome, reads.where(F.lit(False))).collect() == []
