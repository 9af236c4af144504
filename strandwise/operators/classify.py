"""k-mers as repetitive, trusted or untrusted.

Defined cases: a k-mer with an underscore raises an error, as does a way of classifying that is not known; k-mers that
no read holds have a count of 0; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import gc_content
from strandwise.operators import counting


#: Share by which expected counts may differ for the order in which their terms were added: closer values count as equal.
NOISE = 1e-12


def below(a: Column, b: Column | float) -> Column:
    """a < b, but not for the rounding of sums."""
    return a < b * (1 - NOISE)


def z_score(obs: Column, bias: Column, e: float | Column, sd: float | Column) -> Column:
    e, sd = (x if isinstance(x, Column) else F.lit(x) for x in (e, sd))
    return (obs / bias - e) / sd


def statistical(z: Column) -> Column:
    """Beyond two deviations."""
    return F.when(z < -2, "UNTRUSTED").when(z > 2, "REPEAT").when(z.isNotNull(), "TRUSTED")


def naive(obs: Column, bias: Column, e: float | Column) -> Column:
    """Below half and from one and a half of the expected count."""
    c = obs / bias
    return F.when(below(c, 0.5 * e), "UNTRUSTED").when(below(c, 1.5 * e), "TRUSTED").when(c.isNotNull(), "REPEAT")


def rule_naive(corrected: Column, e: Column) -> Column:
    """The rule model over features: one and a half itself is trusted."""
    return F.when(below(corrected, 0.5 * e), 2).when(below(1.5 * e, corrected), 0).when(corrected.isNotNull(), 1)


def rule_statistical(z: Column) -> Column:
    return F.when(z < -2, 2).when(z > 2, 0).when(z.isNotNull(), 1)


def by_genome(kmers: DataFrame, genome_counts: DataFrame) -> DataFrame:
    """kmers with class: how often the genome's two strands hold each, none, once or more."""
    known = genome_counts.select("kmer", F.col("n").alias("genome_n"))
    return kmers.join(known, "kmer", "left").withColumn("class", genome_class(F.coalesce("genome_n", F.lit(0)))).drop("genome_n")


def genome_class(n: Column) -> Column:
    return F.when(n == 0, "UNTRUSTED").when(n == 1, "TRUSTED").otherwise("REPEAT")


def with_features(kmers: DataFrame, counts: DataFrame, bias: DataFrame, expected: DataFrame, bias_k: int) -> DataFrame:
    """kmers with n, bias, e, sd and z: what a k-mer's count is judged by.

    counts: kmer and n of all sizes that occur; bias: gc_bin 0 to bias_k and bias; expected: k, e and sd of all sizes.
    """
    checked = kmers.withColumn("kmer", F.when(F.col("kmer").contains("_"), F.raise_error(F.lit("an underscore is in the k-mer"))).otherwise(F.col("kmer")))
    met = checked.join(counts.select("kmer", "n"), "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = counting.bias_of(met, bias, bias_k).join(F.broadcast(expected.select("k", "e", "sd")), F.length("kmer") == F.col("k")).drop("k")
    return met.withColumn("z", z_score(F.col("n"), F.col("bias"), F.col("e"), F.col("sd")))


#: Ways of classifying, by the numbers that settings use for them; the last looks at the genome itself.
CLASSIFICATION_TYPES = ("STATISTICAL", "NAIVE", "MACHINE_LEARNING", "CHEATING")


def classified(kind: str, kmers: DataFrame, counts: DataFrame, bias: DataFrame, expected: DataFrame, bias_k: int, genome_counts: DataFrame | None = None, model=None) -> DataFrame:  # noqa: ANN001
    """kmers with n, bias, e, sd, z and class, in one of the CLASSIFICATION_TYPES."""
    if kind not in CLASSIFICATION_TYPES:
        raise ValueError(f"no such way of classifying: {kind}")
    each = with_features(kmers, counts, bias, expected, bias_k)
    if kind == "STATISTICAL":
        return each.withColumn("class", statistical(F.col("z")))
    if kind == "NAIVE":
        return each.withColumn("class", naive(F.col("n"), F.col("bias"), F.col("e")))
    if kind == "CHEATING":
        if genome_counts is None:
            raise ValueError("CHEATING needs the genome's k-mers")
        return by_genome(each, genome_counts)
    if model is None:
        raise ValueError("MACHINE_LEARNING needs a model")
    from strandwise.operators import learning

    return learning.classify_kmers(each, model)


def kmer_features(each: DataFrame) -> DataFrame:
    """each with the six features that models of k-mers look at, under the names of their training rows."""
    return each.select(
        "*",
        F.col("z").alias("ZScore"),
        gc_content(F.col("kmer")).alias("gcContent"),
        F.length("kmer").cast("double").alias("size"),
        F.col("n").cast("double").alias("observedCount"),
        (F.col("n") / F.col("bias")).alias("biasCorrectedObservedCount"),
        F.col("e").alias("expectedCountPusm"),
    )


def counts_of(seqs: DataFrame, ks: list[int], both: bool = True) -> DataFrame:
    """kmer and n for several sizes."""
    count = counting.count_both if both else counting.count_forward
    out = count(seqs, ks[0])
    for k in ks[1:]:
        out = out.unionByName(count(seqs, k))
    return out
