"""Results that are kept: k-mer counts, biases, profiles and models, plot data, and texts of corrected reads.

`stored` is how all of them are kept: if the folder is there, it is read, else the table is made and written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import classify, profiles


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """The table in the folder; if the folder is not there or not whole, it is made and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        table = make().write.mode("overwrite")
        (table.partitionBy(partition) if partition else table).parquet(path)
    return spark.read.parquet(path)


def kmer_counts(spark: SparkSession, path: str, seqs: DataFrame, ks: list[int]) -> DataFrame:
    """kmer, n and k of the sequences for all sizes, kept by size: a reader of one size opens only its files."""
    return stored(spark, path, lambda: classify.counts_of(seqs, ks).withColumn("k", F.length("kmer")), "k")


def save_profile(profile: profiles.ErrorProfile, path: str) -> None:
    """An overall or motif profile as folders of tables."""
    if isinstance(profile, profiles.OverallProfile):
        profile.rates.write.mode("overwrite").parquet(f"{path}/rates")
        profile.matrix.write.mode("overwrite").parquet(f"{path}/matrix")
        profile.rates.sparkSession.createDataFrame([(profile.bases,)], "bases long").write.mode("overwrite").parquet(f"{path}/bases")
    elif isinstance(profile, profiles.MotifProfile):
        profile.z.write.mode("overwrite").parquet(f"{path}/motifs")
    else:
        raise ValueError("only overall and motif profiles are tables; store a classifier profile's models one by one")


def load_profile(spark: SparkSession, path: str) -> profiles.ErrorProfile:
    if exists(spark, f"{path}/motifs"):
        return profiles.MotifProfile(spark.read.parquet(f"{path}/motifs"))
    bases = spark.read.parquet(f"{path}/bases").first().bases
    return profiles.OverallProfile(spark.read.parquet(f"{path}/rates"), spark.read.parquet(f"{path}/matrix"), bases)


def plot_data(points: DataFrame, x: str, y: str) -> DataFrame:
    """x and y in the order of x."""
    return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).orderBy("x")


def write_plot(points: DataFrame, x: str, y: str, path: str) -> None:
    """The points as one file of lines x,y."""
    plot_data(points, x, y).coalesce(1).write.mode("overwrite").csv(path)


def overlaid(series: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """series, x and y of several plots in one."""
    out = None
    for name, points in series.items():
        each = points.select(F.lit(name).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        out = each if out is None else out.unionByName(each)
    return out


def bias_text(gc_bin: Column, bias: Column, k: int) -> Column:
    """A bias as it is printed: its bin's GC content and the value."""
    return F.concat(F.lit("biases["), (gc_bin / F.lit(float(k))).cast("string"), F.lit("] = "), bias.cast("string"))


def profile_text(kind: Column, log_p: Column) -> Column:
    """A type's logarithm of its probability as it is printed; a type never seen prints -Infinity."""
    return F.concat(F.lit("P["), kind, F.lit("] = "), F.coalesce(log_p.cast("string"), F.lit("-Infinity")))


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", name, seq, F.lit("+"), qual)


def corrected_text(original: Column, corrected: Column, corrections: Column) -> Column:
    """The read before and after, a blank line, and its corrections (an array of texts); empty without corrections."""
    return F.when(F.size(corrections) > 0, F.concat(original, F.lit("\n"), corrected, F.lit("\n"), F.concat_ws("", F.transform(corrections, lambda c: F.concat(F.lit("\n"), c))))).otherwise("")


def aligned_text(original: Column, corrected: Column, begin_pos: Column, bases: Column) -> Column:
    """The read before and after and the place it lies at; empty if no bases are left."""
    return F.when(F.length(bases) > 0, F.concat(original, F.lit("\n"), corrected, F.lit("\n"), begin_pos.cast("string"))).otherwise("")
