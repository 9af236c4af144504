"""Sequence files as DataFrames and back. Files are read by Spark's own text reader, so any store it knows will do.

Defined cases: blank lines at the end are passed over; an empty file gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import read_name


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line (from 0) and value. Lines are counted per block first; one row a block, not a line, is put in order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", "block", (F.col("id") - F.col("first") + F.col("base")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, gaps: bool = False) -> DataFrame:
    """read_id, seq and qual of four-line records. Letters other than ACGT become N; with `gaps`, `_` stays and ids keep their @ but are cut at / or space."""
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    rows = lines.groupBy("file", "record").agg(*[F.max(F.when(F.col("part") == i, F.col("value"))).alias(c) for i, c in ((0, "id"), (1, "seq"), (3, "qual"))])
    rows = rows.where(F.col("id").startswith("@"))
    name = read_name(F.col("id")) if gaps else F.expr("substring(id, 2)")
    return rows.select(name.alias("read_id"), F.regexp_replace(F.upper("seq"), "[^ACGT_]" if gaps else "[^ACGT]", "N").alias("seq"), F.coalesce("qual", F.lit("")).alias("qual"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq of each line that is not empty."""
    return spark.read.text(path).select(F.col("value").alias("seq")).where(F.col("seq") != "")


def read_fasta(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """contig (name) and seq of each record; with `first_only`, of each file's first.

    A contig ends up as one value, so it must fit into a task; within a block of the file, lines look back for their head.
    """
    lines = numbered_lines(spark, path).withColumn("head", F.when(F.col("value").startswith(">"), F.struct("line", F.expr("substring(value, 2)").alias("contig"))))
    ends = lines.groupBy("file", "block").agg(F.max("head").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("file", "block").orderBy("line")
    body = lines.withColumn("own", F.max("head").over(within)).where(F.col("head").isNull() & (F.col("value") != ""))
    body = body.join(F.broadcast(carried), ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    body = body.where("record.line = 0") if first_only else body
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))
    return body.groupBy("file", "record").agg(F.concat_ws("", F.transform(parts, lambda x: x["value"])).alias("seq")).select("record.contig", F.upper("seq").alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """line (of the file, from 0), read_id, flag, contig, begin_pos (from 0), cigar, seq, qual and md of each alignment line."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return rows.select(
        "line", f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("begin_pos"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"),
        F.nullif(F.regexp_extract("value", r"\tMD:Z:(\S+)", 1), F.lit("")).alias("md"),
    )


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four lines a read; reads without bases are passed over."""
    reads.where(F.length("seq") > 0).select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual")).write.text(path)


def write_training_rows(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", ";").option("header", True).csv(path)


def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).option("inferSchema", True).csv(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """type, pos, old, new and prob of lines as correction_text() writes them; a dot or an underscore alone stands for no base."""
    f = F.split("value", " ")
    none = lambda c: F.when(c.isin(".", "_"), "").otherwise(c)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(f[0].alias("type"), f[1].cast("int").alias("pos"), none(f[2]).alias("old"), none(f[3]).alias("new"), f[4].cast("double").alias("prob"))


def read_true_corrections(spark: SparkSession, path: str) -> DataFrame:
    """read_id, orig_pos and type of a store of true corrections (Parquet)."""
    return spark.read.parquet(path).select("read_id", "orig_pos", "type")


def read_plot_script(spark: SparkSession, path: str) -> DataFrame:
    """x and y of the points below a script's first line that begins with plot; short lines are passed over."""
    lines = numbered_lines(spark, path)
    starts = lines.where(F.col("value").startswith("plot")).groupBy("file").agg(F.min("line").alias("start"))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.join(F.broadcast(starts), "file").where((F.col("line") > F.col("start")) & (F.length("value") > 2))
    return rows.select(f[0].cast("double").alias("x"), f[1].cast("double").alias("y"))


def write_true_reads(reads: DataFrame, path: str) -> None:
    """Four lines a read of read_id, true_seq and, if there, qual (else the best quality there is)."""
    qual = F.col("qual") if "qual" in reads.columns else F.repeat(F.lit("I"), F.length("true_seq"))
    write_fastq(reads.select(F.regexp_replace(F.col("read_id").cast("string"), "^@", "").alias("read_id"), F.col("true_seq").alias("seq"), qual.alias("qual")), path)
