"""A training corpus out of `documents`: clean, good, distinct, free of personal data, packed.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of docs; the last returns pieces.

Defined cases, all stages: a null text counts as empty, but stays null in the columns returned; rows with a null
doc_id go through every stage and belong to no group; an empty table gives an empty table; further columns of docs
are carried along. Rows that repeat a doc_id with the same text are copies of each other and one stays; rows that
share a doc_id but not a text stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import ngram_join, packing, pii, quality, toxicity
from strandwise.llm.common import table
from strandwise.session import written


#: Rows that go to a Python worker at once: whole texts are held there and, as Arrow vectors, beside the JVM's heap.
BATCH_ROWS = 1000
#: Rows that Parquet's reader decodes at once: it holds their whole texts in one vector on the JVM's heap, which doubles as it grows.
READ_ROWS = 256


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with at most BATCH_ROWS rows in an Arrow batch of the session and READ_ROWS in one of Parquet's reader; a lower number stays."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
            if not 0 < int(spark.conf.get(name)) <= most:
                spark.conf.set(name, str(most))
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.3 for toxicity."""
    model = toxicity.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model, docs.columns, threshold=0.3)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least 0.7 for quality."""
    net = quality.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.kept(docs, net, docs.columns, threshold=0.7)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the smallest doc_id of their component of near duplicates."""
    first = ngram_join.classes_of(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").select(*docs.columns)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    single = named.withColumn("__digest", digest).dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return single.unionByName(docs.where(F.col("doc_id").isNull()))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each span of personal data in text gives way to its kind in angle brackets."""
    return pii.redacted(docs, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024, lasting=False)
    return packing.pack(cut, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("quality", in_small_batches(keep_good)),
    ("ngram_jaccard", in_small_batches(one_of_each_group)),
    ("pii", in_small_batches(mask_personal_data)),
    ("packing", in_small_batches(pack_sequences)),
]

#: Networks, a random field and a tokenizer have no SQL; tests compare run() with plain versions of the last three stages
#: and the networks with held-out labels, not with a network written twice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
