"""k-mer counts, expected counts and bias by GC content.

Defined cases: reads without a sequence, or shorter than k, have no k-mers; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import ERROR_TYPES, gc_bin, gc_count, kmers, part_of, reverse_complement, undo_error
from strandwise.operators import packed

TILE = 65_536
#: Bases whose k-mers are cut out of one row: each is looked for from the row's start.
CUT = 256


def tiles(seqs: DataFrame, k: int, keep: list[str], seq: str = "seq", step: int = CUT) -> DataFrame:
    """keep, start and part: overlapping stretches that hold each k-mer once; a long contig becomes many rows, never one array."""
    long = seqs.where(F.length(seq) >= k).select(*keep, F.col(seq).alias("__seq"), F.explode(F.sequence(F.lit(0), F.length(seq) - k, F.lit(step))).alias("start"))
    return long.select(*keep, "start", part_of(F.col("__seq"), F.col("start"), step + k - 1).alias("part"))


def positions(seqs: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """keep, pos and kmer of every k-mer. Sequences are ASCII."""
    each = tiles(seqs, k, keep, seq).select(*keep, "start", F.inline(kmers(F.col("part"), k)))
    return each.select(*keep, (F.col("start") + F.col("pos")).alias("pos"), "kmer")


def _lettered(counts: DataFrame, k: int) -> DataFrame:
    return counts.select(F.coalesce("odd", packed.letters(F.col("code"), k)).alias("kmer"), "n")


def count_forward(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer and its number n, on the strand as given; counted before the shuffle."""
    if k > packed.LONGEST:
        return positions(seqs, k, [], seq).groupBy("kmer").agg(F.count("*").alias("n"))
    return _lettered(packed.counted(seqs, k, both=False, seq=seq), k)


def count_both(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer and its number n on both strands: palindromes count twice. One shuffle, of one strand of each distinct k-mer."""
    if k > packed.LONGEST:
        strand = F.least("kmer", reverse_complement(F.col("kmer")))
        one = positions(seqs, k, [], seq).groupBy(strand.alias("kmer")).agg(F.count("*").alias("n"))
    else:
        one = _lettered(packed.counted(seqs, k, both=True, seq=seq), k)
    other = reverse_complement(F.col("kmer"))
    here, there = F.struct("kmer", "n"), F.struct(other.alias("kmer"), "n")
    twice = F.struct("kmer", (2 * F.col("n")).alias("n"))
    return one.select(F.inline(F.when(F.col("kmer") == other, F.array(twice)).otherwise(F.array(here, there))))


def expected_errors(counts: DataFrame, kmers_: DataFrame, profile: DataFrame) -> DataFrame:
    """kmer and n, the number of its occurrences that a profile of errors lets expect (approximate counts).

    counts: kmer and n, for sizes k - 1, k and k + 1, on the strands that are to be counted. profile: base, type and log_p, what each error type's chance is at each read base (types without a row: none). Sums
    over each place and type the type's chance by the number of the k-mer as it was before the error, and adds the
    number of the k-mer itself by the chance that no place of it holds an error. Only one error a k-mer is looked at.
    """
    at = kmers_.select("kmer").distinct().select("kmer", F.posexplode(F.split("kmer", "")).alias("pos", "base")).where("base <> ''")
    met = at.join(F.broadcast(profile.select("base", "type", F.exp("log_p").alias("p"))), "base")
    whole = at.join(F.broadcast(profile.where(F.col("type").isin("CORRECT", "NODEL")).select("base", "log_p")), "base").groupBy("kmer").agg(F.exp(F.sum("log_p")).alias("p"))
    tried = met.where(~F.col("type").isin("CORRECT", "NODEL", "MULTIDEL")).select("kmer", "p", undo_error(F.col("kmer"), F.col("type"), F.col("pos")).alias("before"))
    before = tried.unionByName(whole.select("kmer", "p", F.col("kmer").alias("before")))
    n = counts.select(F.col("kmer").alias("before"), F.col("n").alias("times"))
    return before.join(n, "before", "left").groupBy("kmer").agg(F.sum(F.col("p") * F.coalesce("times", F.lit(0))).alias("n"))


def read_lengths(reads: DataFrame, seq: str = "seq") -> DataFrame:
    return reads.where(F.col(seq).isNotNull()).groupBy(F.length(seq).alias("length")).agg(F.count("*").alias("n"))


def expected_counts(lengths: DataFrame, genome_size: int, ks: list[int], circular: bool = True) -> DataFrame:
    """k, expected count e and its deviation sd. A chance outside 0 to 1 raises an error."""
    g = F.lit(genome_size).cast("double")
    each = lengths.select("length", "n", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    l, k = F.col("length").cast("double"), F.col("k")
    p = (l - k + 1) / g if circular else (l - k) * (g - l) / ((g - k + 1) * (g - l + 1))
    if not circular:
        each = each.withColumn("length", F.when(l <= g, F.col("length")).otherwise(F.raise_error(F.lit("a read is longer than the genome")).cast("int")))
    each = each.where(l >= k).withColumn("p", F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("not a chance")).cast("double")))
    return each.groupBy("k").agg(F.sum(F.col("n") * F.col("p")).alias("e"), F.sqrt(F.sum(F.col("n") * F.col("p") * (1 - F.col("p")))).alias("sd"))


def _medians(ratios: DataFrame) -> DataFrame:
    """gc_bin, bias and the number of ratios; equal ratios are counted first, so no task holds a whole bin."""
    few = ratios.groupBy("gc_bin", "ratio").agg(F.sum("times").alias("times"))
    return few.groupBy("gc_bin").agg(F.expr("percentile(ratio, 0.5, times)").alias("bias"), F.sum("times").alias("n_ratios"))


def bias_from_reference(genome: DataFrame, counts: DataFrame, k: int, expected: float, seq: str = "seq") -> DataFrame:
    """Median over all genome positions of observed over expected count, by GC bin; unseen k-mers take no part."""
    occurrences = count_forward(genome, k, seq).withColumnRenamed("n", "occ")
    met = occurrences.join(counts, "kmer").where("n > 0")
    return _medians(met.select(gc_bin(F.col("kmer")).alias("gc_bin"), (F.col("n") / (F.lit(expected) * F.col("occ"))).alias("ratio"), F.col("occ").alias("times")))


def bias_from_reads(forward: DataFrame, counts: DataFrame, expected: float, least: float = 0.2) -> DataFrame:
    """Median over distinct read k-mers seen at least `least` times as often as expected, by GC bin."""
    met = forward.select("kmer").join(counts, "kmer").where(F.col("n") >= least * expected)
    return _medians(met.select(gc_bin(F.col("kmer")).alias("gc_bin"), (F.col("n") / F.lit(expected)).alias("ratio"), F.lit(1).cast("long").alias("times")))


def covered(genome: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """contig, pos and obs: how many of the spans (contig, first, last) hold the whole k-mer at pos.

    A sweep over starts and ends replaces the interval tree. Each contig is cut into tiles whose sums are added up
    first, so that a long contig is not the work of one task.
    """
    whole = spans.where(F.col("last") - F.col("first") + 1 >= k)
    steps = whole.select("contig", F.inline(F.array(F.struct(F.col("first").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("last") - k + 2).alias("pos"), F.lit(-1).alias("step")))))
    size = F.length("seq")
    parts = genome.where(size >= k).select("contig", (size - k).alias("last"), F.explode(F.sequence(F.lit(0), size - k, F.lit(TILE))).alias("from"))
    here = parts.select("contig", F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + TILE - 1))).alias("pos"), F.lit(0).alias("step"))
    moves = steps.select("contig", F.col("pos").cast("long").alias("pos"), "step").unionByName(here.select("contig", F.col("pos").cast("long").alias("pos"), "step"))
    moves = moves.groupBy("contig", "pos").agg(F.sum("step").alias("step"), F.max(F.col("step") == 0).alias("real")).withColumn("tile", F.floor(F.col("pos") / TILE))
    before = Window.partitionBy("contig").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    base = moves.groupBy("contig", "tile").agg(F.sum("step").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    within = Window.partitionBy("contig", "tile").orderBy("pos")
    run = moves.withColumn("here", F.sum("step").over(within)).join(base, ["contig", "tile"])
    return run.where("real").select("contig", "pos", (F.col("here") + F.col("base")).alias("obs"))


def bias_from_alignment(genome: DataFrame, spans: DataFrame, k: int, expected: float) -> DataFrame:
    """As bias_from_reference, with the number of spans over each position as the observed count."""
    at = positions(genome, k, ["contig"]).select("contig", F.col("pos").cast("long").alias("pos"), "kmer")
    met = at.join(covered(genome, spans, k).where("obs > 0"), ["contig", "pos"])
    occ = count_forward(genome, k).withColumnRenamed("n", "occ")
    few = met.groupBy("kmer", "obs").agg(F.count("*").alias("times")).join(occ, "kmer")
    return _medians(few.select(gc_bin(F.col("kmer")).alias("gc_bin"), (F.col("obs") / (F.lit(expected) * F.col("occ"))).alias("ratio"), "times"))


def fill_bias(values: list[float]) -> list[float]:
    """Zeros take the nearest value on the outside and the mean of their neighbours inside, left to right, till none is left."""
    out = list(values)
    full = [i for i, v in enumerate(out) if v]
    if not full:
        return [1.0] * len(out)
    out[0], out[-1] = out[full[0]], out[full[-1]]
    while not all(out):
        for i, v in enumerate(out[1:-1], 1):
            if not v:
                out[i] = (out[i - 1] + out[i + 1]) / 2
    return out


def filled_bias(bias: DataFrame, k: int) -> DataFrame:
    """gc_bin 0 to k and bias, empty bins filled as by fill_bias: one row goes through the JVM's array functions, nothing is collected.

    One pass from left to right leaves no zero inside: each takes the mean of its left neighbour, which is full by
    then, and its right one, empty or not.
    """
    bins = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.coalesce(F.try_element_at(F.col("known"), i), F.lit(0.0)))
    known = bias.agg(F.map_from_entries(F.collect_list(F.struct("gc_bin", "bias"))).alias("known")).select(bins.alias("b"))
    full = F.filter("b", lambda x: x != 0)
    known = known.select("b", full.alias("full")).select(
        F.when(F.size("full") == 0, F.transform("b", lambda x: F.lit(1.0)))
        .otherwise(F.concat(F.slice("full", 1, 1), F.slice("b", 2, k - 1), F.slice("full", -1, 1)))
        .alias("b")
    )
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).alias("i"))

    def step(acc, x):  # noqa: ANN001, ANN202
        here = F.when(x != 0, x).otherwise((F.try_element_at(acc["out"], F.lit(-1)) + F.get(F.col("b"), acc["i"] + 1)) / 2)
        return F.struct(F.concat(acc["out"], F.array(here)).alias("out"), (acc["i"] + 1).alias("i"))

    return known.select(F.posexplode(F.aggregate("b", start, step, lambda acc: acc["out"])).alias("gc_bin", "bias"))


def bias_of(kmers_: DataFrame, bias: DataFrame, k: int) -> DataFrame:
    """kmers with bias: linear interpolation between the two bins around each k-mer's GC content; bias has bins 0 to k."""
    at = gc_count(F.col("kmer")) * k / F.length("kmer")
    table = F.broadcast(bias.agg(F.transform(F.sort_array(F.collect_list(F.struct("gc_bin", "bias"))), lambda x: x["bias"]).alias("__bins")))
    low = F.floor("__at").cast("int")
    a, b = F.get("__bins", low), F.get("__bins", F.least(low + 1, F.lit(k)))
    return kmers_.withColumn("__at", at).crossJoin(table).withColumn("bias", a + (F.col("__at") - low) * (b - a)).drop("__at", "__bins")


#: How a bias is learned, by the numbers that settings use for it.
BIAS_TYPES = ("IGNORE", "ALIGNMENT", "REFERENCE", "READS_ONLY")


def learned_bias(kind: str, k: int, expected: float, reads: DataFrame | None = None, genome: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """gc_bin 0 to k and bias, learned as one of BIAS_TYPES says, without empty bins; another name, or a table that the kind needs and lacks, raises an error."""
    if kind not in BIAS_TYPES:
        raise ValueError(f"no such bias type: {kind}")
    if kind == "IGNORE":
        some = reads if reads is not None else genome if genome is not None else spans
        return some.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("gc_bin"), F.lit(1.0).alias("bias"))
    needed = {"ALIGNMENT": (genome, spans), "REFERENCE": (genome, reads), "READS_ONLY": (reads,)}[kind]
    if any(t is None for t in needed):
        raise ValueError(f"a table is missing for bias type {kind}")
    if kind == "ALIGNMENT":
        found = bias_from_alignment(genome, spans, k, expected)
    elif kind == "REFERENCE":
        found = bias_from_reference(genome, count_both(reads, k), k, expected)
    else:
        found = bias_from_reads(count_forward(reads, k), count_both(reads, k), expected)
    return filled_bias(found, k)
