"""Growing k-mers and every way of correcting against plain loops over single reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions.sequence import ERROR_TYPES
from strandwise.operators import classify, correction, counting, ladders, profiles

K, LONGEST = 5, 11


def other(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


class Plain:
    """Classes by a genome, looked up one by one."""

    def __init__(self, genome):
        self.genome = genome

    def kind(self, kmer):
        n = sum(g[i : i + len(kmer)] == s for g in (self.genome,) for s in (kmer, other(kmer)) for i in range(len(g) - len(kmer) + 1))
        return "UNTRUSTED" if n == 0 else "TRUSTED" if n == 1 else "REPEAT"

    def first(self, windows):
        for w in windows:
            if self.kind(w) != "REPEAT":
                return self.kind(w), w
        return "REPEAT", None


def onward(s, pos):
    if len(s) < K:
        return []
    start = min(pos, len(s) - K)
    out = [s[start : start + n] for n in range(K, LONGEST + 1, 2) if start + n <= len(s)]
    reach, at = start + len(out[-1]), start - 2
    while at >= 0 and reach - at <= LONGEST:
        out.append(s[at:reach])
        at -= 2
    return out


def around(s, pos, middle):
    a, b, turn, w, out = pos, len(s) - pos - 1, True, middle, []
    i = j = 0
    while (i < a or j < b) and len(w) < min(LONGEST, len(s)):
        if (turn and i < a) or j == b:
            i += 1
            w = s[pos - i] + w
        else:
            j += 1
            w = w + s[pos + j]
        turn = not turn
        if len(w) >= K and len(w) % 2:
            out.append(w)
    return out


def undone(s, kind, pos):
    if kind.startswith("SUB"):
        return s[:pos] + kind[-1] + s[pos + 1 :]
    return s[:pos] + s[pos + 1 :] if kind == "INSERTION" else s[: pos + 1] + kind[-1] + s[pos + 1 :]


def possible(s, pos):
    return [t for t in ERROR_TYPES[1:10] if not (t.startswith("SUB") and t[-1] == s[pos]) and (t.startswith("SUB") or pos < len(s) - 1)]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    unit = "".join(rng.choice("ACGT") for _ in range(14))
    genome = "".join(rng.choice("ACGT") for _ in range(150)) + unit + "".join(rng.choice("ACGT") for _ in range(60)) + unit
    reads = []
    for i in range(60):
        at = rng.randrange(len(genome) - 24)
        r = list(genome[at : at + 24])
        for _ in range(rng.choice((0, 1, 1, 2))):
            p = rng.randrange(len(r))
            what = rng.random()
            if what < 0.5:
                r[p] = rng.choice("ACGT")
            elif what < 0.75:
                del r[p]
            else:
                r.insert(p, rng.choice("ACGT"))
        reads.append((i, "".join(r)))
    reads += [(100, "ACG"), (101, ""), (102, None), (103, unit)]
    frame = spark.createDataFrame(reads, "read_id long, seq string").coalesce(1)
    seqs = spark.createDataFrame([(1, genome)], "contig long, seq string")
    counts = classify.counts_of(seqs, list(range(K, LONGEST + 1, 2)))
    table = counts.select("kmer", classify.genome_class(F.col("n")).alias("class")).coalesce(1).cache()
    return Plain(genome), dict(reads), frame, table


def test_growing_windows(spark, world):
    plain, reads, frame, table = world
    each = frame.where("length(seq) > 0").withColumn("pos", F.expr("cast(read_id % length(seq) as int)"))
    seq, pos = F.col("seq"), F.col("pos")
    ways = {
        "onward": (ladders.onward(seq, pos, K, LONGEST), onward),
        "around": (ladders.middle(seq, pos, F.lit("A"), K, LONGEST), lambda s, p: around(s, p, "A")),
        "left": (ladders.left_of(seq, pos, K, LONGEST), lambda s, p: [s[p - n : p] for n in range(K, LONGEST + 1, 2) if p >= n]),
        "right": (ladders.right_of(seq, pos, K, LONGEST), lambda s, p: [s[p + 1 : p + 1 + n] for n in range(K, LONGEST + 1, 2) if p + 1 + n <= len(s)]),
    }
    rows = each.select("read_id", "pos", F.inline(F.array(*[F.struct(F.lit(name).alias("way"), ladder.alias("ladder")) for name, (ladder, _) in ways.items()])))
    expected = {(r.read_id, r.way): ways[r.way][1](reads[r.read_id], r.pos) for r in rows.collect()}
    assert {(r.read_id, r.way): r.ladder for r in rows.collect()} == expected
    found = {(r.read_id, r.way): (r["class"], r.window) for r in ladders.decided(rows, "ladder", table, ["read_id", "way"], window=True).collect()}
    assert found == {key: plain.first(windows) for key, windows in expected.items()}
    gap = spark.createDataFrame([(1, "ACGTA_CGTACG")], "read_id long, seq string")
    assert gap.select(ladders.left_of(F.col("seq"), F.lit(9), 3, 7).alias("l")).first().l == ["CGT"]
    assert gap.select(ladders.middle(F.col("seq"), F.lit(5), F.lit(""), 3, 7).alias("l")).first().l == ["TAC", "GTACG", "CGTACGT"]


def unbounded(s, pos):
    """Windows that grow on the right to the read's end, then on the left to its beginning."""
    start = min(pos, len(s) - K)
    reach = start + K + 2 * ((len(s) - start - K) // 2)
    return [s[start:e] for e in range(start + K, reach + 1, 2)] + [s[a:reach] for a in range(start - 2, -1, -2)]


def test_growing_correction(world):
    plain, reads, frame, _ = world
    expected = set()
    for i, s in reads.items():
        if not s or len(s) < K:
            continue
        for pos in range(len(s)):
            kind, window = plain.first(unbounded(s, pos))
            if kind == "REPEAT":
                break
            if kind != "UNTRUSTED":
                continue
            for n in range(len(window), len(s) + 1, 2):
                hold = []
                for t in possible(s, pos):
                    m = undone(s, t, pos)
                    places = [max(0, min(pos - back, len(m) - n)) for back in (0, correction.BEFORE)]
                    if len(m) >= n and all(plain.kind(m[p : p + n]) != "UNTRUSTED" for p in places):
                        hold.append(t)
                if len(hold) <= 1:
                    expected |= {(i, pos, t) for t in hold}
                    break

    def classes(sizes):
        counts = classify.counts_of(frame.sparkSession.createDataFrame([(1, plain.genome)], "contig long, seq string"), sizes)
        return counts.select("kmer", classify.genome_class(F.col("n")).alias("class"))

    found = {(r.read_id, r.orig_pos, r.type) for r in correction.by_growing_kmers(frame, classes, K).collect()}
    assert found == expected and expected
    starts = {(r.read_id, r.start): (r["class"], r.n) for r in ladders.grown_starts(frame, classes, K).collect()}
    firsts = {(i, p): plain.first(unbounded(s, p)) for i, s in reads.items() if s for p in range(len(s) - K + 1)}
    assert starts == {at: (kind, window and len(window)) for at, (kind, window) in firsts.items()}


def test_equal_reads_are_judged_once(world, monkeypatch):
    _, _, frame, table = world
    copies = frame.unionByName(frame.withColumn("read_id", F.col("read_id") + 10_000)).unionByName(frame.withColumn("read_id", F.col("read_id") + 20_000))
    judged, grown = [], ladders.grown_starts
    monkeypatch.setattr(ladders, "grown_starts", lambda reads, classes, k: judged.append(reads.count()) or grown(reads, classes, k))
    classes = lambda sizes: table.where(F.length("kmer").isin(sizes))
    found = {(r.read_id, r.orig_pos, r.type) for r in correction.by_growing_kmers(copies, classes, K).collect()}
    once = {x for x in found if x[0] < 10_000}
    assert judged == [frame.where("seq is not null").select("seq").distinct().count()]
    assert once and found == {(i + more, at, kind) for i, at, kind in once for more in (0, 10_000, 20_000)}


class Letters(profiles.ErrorProfile):
    """A made-up profile: every type has a score by its number and the base."""

    def scores(self, at):
        kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(float((7 * n) % 12)).alias("x")) for n, t in enumerate(ERROR_TYPES)])
        base = F.ascii(F.expr("substring(seq, cast(orig_pos + 1 as int), 1)"))
        each = at.select("read_id", "orig_pos", base.alias("b"), F.inline(kinds))
        return each.where(F.col("type") != F.concat(F.lit("SUB_FROM_"), F.char("b"))).select("read_id", "orig_pos", "type", (F.col("x") + F.col("b") % 5).cast("double").alias("score"))


def score(base, n):
    return (7 * n) % 12 + ord(base) % 5


@pytest.mark.parametrize("indels", [True, False])
def test_ranked_correction(world, indels):
    plain, reads, frame, table = world
    expected = set()
    for i, s in reads.items():
        if not s or len(s) < K:
            continue
        start, last = 0, len(s) - K
        while True:
            at = min(start, last)
            kind, window = plain.first([s[at : at + n] for n in range(K, LONGEST + 1, 2) if at + n <= len(s)])
            n = len(window) if window else K
            if kind == "UNTRUSTED":
                ranked = sorted((-score(s[p], e), p, e) for p in range(at, at + n) for e, t in enumerate(ERROR_TYPES) if t not in ("CORRECT", "NODEL", "MULTIDEL") and t != "SUB_FROM_" + s[p])
                for _, p, e in ranked:
                    t = ERROR_TYPES[e]
                    if t.startswith("DEL"):
                        ok = p < len(s) - 1
                        ok = ok and plain.first([s[p + 1 - m : p + 1] for m in range(K, LONGEST + 1, 2) if p + 1 >= m])[0] != "UNTRUSTED"
                        ok = ok and plain.first([s[p + 1 : p + 1 + m] for m in range(K, LONGEST + 1, 2) if p + 1 + m <= len(s)])[0] != "UNTRUSTED"
                        ok = ok and plain.first(around(s, p, ""))[0] == "UNTRUSTED" and plain.first(around(s, p, s[p] + t[-1]))[0] == "TRUSTED"
                    else:
                        m = undone(s[at : at + n], t, p - at) + s[at + n :]
                        ok = len(m) >= n and plain.first([m[:z] for z in range(n, max(n, min(LONGEST, len(m))) + 1, 2)])[0] == "TRUSTED"
                    if ok:
                        expected.add((i, p, t))
                        break
            if at == last:
                break
            start = at + (max(1, n // 2) if indels else n)
    found = {(r.read_id, r.orig_pos, r.type) for r in correction.by_ranked_kmers(frame, Letters(), table, K, LONGEST, indels).collect()}
    assert found == expected and expected


def test_naive_and_dispatch(world):
    _, reads, frame, table = world
    found = {(r.read_id, r.orig_pos, r.type) for r in correction.corrector("NAIVE", table, K, Letters())(frame).collect()}
    expected = set()
    for i, s in reads.items():
        for p, base in enumerate(s or ""):
            for low, high in ((0, 6), (6, 12)):
                best = max((e for e in range(low, high) if ERROR_TYPES[e] != "SUB_FROM_" + base), key=lambda e: (score(base, e), -e))
                if ERROR_TYPES[best] not in ("CORRECT", "NODEL") and (low == 0 or p < len(s) - 1):
                    expected.add((i, p, ERROR_TYPES[best]))
    assert found == expected
    with pytest.raises(ValueError):
        correction.corrector("OTHER", table, K)
    with pytest.raises(ValueError):
        correction.corrector("KMER_BASED", table, K)


def test_applied_corrections(spark):
    reads = spark.createDataFrame([(1, "ACGT", "!#%'"), (2, "AC", "II"), (3, None, None), (4, "", "")], "read_id long, seq string, qual string")
    fixes = [(1, 0, "DEL_OF_G"), (1, 1, "INSERTION"), (1, 2, "SUB_FROM_T"), (1, 3, "DEL_OF_A"), (2, 0, "MULTIDEL")]
    out = {r.read_id: r for r in correction.apply(reads, spark.createDataFrame(fixes, "read_id long, orig_pos long, type string")).collect()}
    assert (out[1].corrected, out[1].corrected_qual, out[1].original_positions) == ("AGTTA", "!\"%''", [0, 0, 2, 3, 3])
    assert (out[2].corrected, out[2].corrected_qual, out[2].original_positions) == ("A_C", "III", [0, 0, 1])
    assert out[3].corrected is None and out[3].original_positions is None and out[4].corrected == "" and out[4].original_positions == []


def test_long_contigs_are_counted_in_pieces(spark, monkeypatch):
    from strandwise.operators import packed

    rng = random.Random(1)
    s = "".join(rng.choice("ACGTN"[: 4 + (rng.random() < 0.02)]) for _ in range(3000))
    monkeypatch.setattr(packed, "BLOCK", 200)
    frame = spark.createDataFrame([(1, s), (2, "ACGTN"), (3, None), (4, "AC")], "contig long, seq string")
    for k in (3, 8):
        plain = {}
        for t in (s, "ACGTN", "AC"):
            for i in range(len(t) - k + 1):
                for w in (t[i : i + k], other(t[i : i + k])):
                    plain[w] = plain.get(w, 0) + 1
        assert {r.kmer: r.n for r in counting.count_both(frame, k).collect()} == plain
        at = counting.positions(frame.where("contig = 1"), k, ["contig"]).collect()
        assert {r.pos: r.kmer for r in at} == {i: s[i : i + k] for i in range(len(s) - k + 1)} and len(at) == len(s) - k + 1


def test_applying_over_the_ends_of_stretches(spark):
    """Fixes at and beside the ends of stretches, several a place, against a plain loop."""
    rng = random.Random(4)
    size = correction.STRETCH * 3 + 1
    seq, qual = "".join(rng.choices("ACGT", k=size)), "".join(chr(33 + rng.randint(0, 40)) for _ in range(size))
    places = [correction.STRETCH * i + d for i in range(4) for d in (-1, 0, 1)] + [size - 1]
    fixes = sorted({(p, rng.choice(ERROR_TYPES[1:11])) for p in places * 2})
    bases, quals, origins = [], [], []
    for p in range(size):
        base, own, q = seq[p], qual[p], qual[p]
        beside = chr((ord(q) + ord(qual[p + 1])) // 2) if p + 1 < size else q
        for _, kind in [f for f in fixes if f[0] == p]:
            if kind == "INSERTION":
                base, own = base[1:], own[1:]
            elif kind.startswith("SUB"):
                base = kind[-1] + base[1:]
            else:
                base, own = base + ("_" if kind == "MULTIDEL" else kind[-1]), own + beside
        bases.append(base)
        quals.append(own)
        origins += [p] * len(base)
    reads = spark.createDataFrame([("r", seq, qual), ("s", seq, qual)], "read_id string, seq string, qual string")
    found = {r.read_id: r for r in correction.apply(reads, spark.createDataFrame([("r", p, k) for p, k in fixes], "read_id string, orig_pos long, type string")).collect()}
    assert (found["r"].corrected, found["r"].original_positions, found["s"].corrected) == ("".join(bases), origins, seq)
    assert found["r"].corrected_qual == "".join(quals)
