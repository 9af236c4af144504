"""Reads, a genome, simulated reads and their alignments out of the driver's tables: whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DNA = "translate(lower(regexp_replace(text, '[^A-Za-z]', '')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
RULE_1, RULE_2, RULE_3 = "(read_id % 20 = 7 and p = 25)", "((read_id * 31 + p * 17) % 89 = 0)", "(read_id % 20 = 13 and p = 20)"
INSERTED = "(read_id % 20 = 13 and (read_id * 31 + 340) % 89 <> 0)"


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is read in fewer: a small file is one task, however much work its rows make."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, seq and qual: stretches of 100 bases, and the rest if it has 30. Qualities rise by 3 a base, modulo 40."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text"))
    docs = docs.selectExpr("doc_id", f"{DNA} as s").where("length(s) >= 30")
    cut = docs.selectExpr("doc_id", "cast(s as binary) as s", "explode(sequence(0, (length(s) - 1) div 100)) as i").selectExpr("doc_id * 1000000 + i as read_id", "cast(substring(s, i * 100 + 1, 100) as string) as seq").where("length(seq) >= 30")
    period = "".join(chr(33 + 3 * j % 40) for j in range(40))
    period = period.replace("\\", "\\\\").replace("'", "\\'")
    return cut.selectExpr("read_id", "seq", f"substring(repeat('{period}', 4), cast(29 * read_id % 40 + 1 as int), length(seq)) as qual")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).selectExpr("item_id as contig", f"{DNA} as seq").where("seq <> ''")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = genome(spark, sf_dir).where("length(seq) >= 50").selectExpr("contig", "seq as g", "explode(sequence(cast(0 as bigint), length(seq) - 50, 3)) as s")
    return each.selectExpr("contig", "s", "contig * 100000 + s as read_id", "substring(g, cast(s + 1 as int), 50) as t")


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, contig, s (its true start) and seq with planted errors."""
    base = f"case when {RULE_1} then '' when {RULE_2} then translate(substring(t, p + 1, 1), 'ACGT', 'CGTA') when {RULE_3} then concat(substring(t, p + 1, 1), 'A') else substring(t, p + 1, 1) end"
    return _starts(spark, sf_dir).selectExpr("read_id", "contig", "s", f"array_join(transform(sequence(0, 49), p -> {base}), '') as seq")


def alignments(spark: SparkSession, sf_dir: str, both_strands: bool = False) -> DataFrame:
    """Where the simulated reads came from; with both strands, reads of odd id were sequenced from the other one."""
    flag = "if(read_id % 2 = 1, 16, 0)" if both_strands else "0"
    return simulated(spark, sf_dir).selectExpr("read_id", f"{flag} as flag", "contig", "s as begin_pos", f"case when read_id % 20 = 7 then '25M1D24M' when {INSERTED} then '21M1I29M' else '50M' end as cigar", "seq")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, orig_pos and type of the planted errors."""
    each = _starts(spark, sf_dir).selectExpr("read_id", "t", "explode(sequence(0, 49)) as p").where(f"{RULE_1} or {RULE_2} or {RULE_3}")
    shift = f"p - if(read_id % 20 = 7 and p > 25, 1, 0) + if({INSERTED} and p > 20, 1, 0)"
    return each.selectExpr(
        "read_id",
        f"cast(case when {RULE_1} then 24 when {RULE_2} then {shift} else 21 end as long) as orig_pos",
        f"case when {RULE_1} then concat('DEL_OF_', substring(t, p + 1, 1)) when {RULE_2} then concat('SUB_FROM_', substring(t, p + 1, 1)) else 'INSERTION' end as type",
    )


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line and the alignments on both strands, with more records for some reads: hard-clipped ones, before or behind the whole one, and unmapped reads."""
    each = alignments(spark, sf_dir, both_strands=True).withColumn("qual", F.expr("repeat(char(cast(40 + read_id % 30 as int)), length(seq) - 1) || 'I'"))
    each = each.withColumn("flag", F.expr("flag + if(read_id % 14 = 5, 4, 0)")).withColumn("line", F.expr("read_id * 3 + 1"))
    part = "read_id", "flag + 256 as flag", "contig", "begin_pos + 1 as begin_pos", "'10H40M' as cigar", "substring(seq, 11) as seq", "substring(qual, 11) as qual"
    before = each.where("read_id % 10 = 3").selectExpr(*part, "line - 1 as line")
    behind = each.where("read_id % 15 = 4").selectExpr(*part, "line + 1 as line")
    return each.unionByName(before).unionByName(behind)


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments on both strands, with the first four bases of some reads clipped off."""
    each = alignments(spark, sf_dir, both_strands=True)
    cut = "read_id % 20 = 11"
    return each.withColumn("cigar", F.expr(f"if({cut}, '4S46M', cigar)")).withColumn("begin_pos", F.expr(f"begin_pos + if({cut}, 4, 0)"))


def md_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id and a made-up MD tag: two substitutions with a deletion between."""
    return simulated(spark, sf_dir).selectExpr("read_id", "concat(read_id % 20, 'A', read_id % 7, '^AC', read_id % 5, 'T', 30) as md")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id and seq of error-free reads in which two to five bases from the 25th on are missing, with an underscore in their place."""
    return _starts(spark, sf_dir).selectExpr("read_id", "concat(left(t, 24), '_', substring(t, cast(27 + read_id % 4 as int), 50)) as seq")
