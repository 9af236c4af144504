"""Each stage of the pipeline against its operator's own judgement."""

import corpus_pipeline as pipeline
import pandas as pd
from strandwise.llm import common, ngram_join, quality, toxicity


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    stages = dict(pipeline.STAGES)
    bad = {r.doc_id for r in toxicity.score_documents(docs, toxicity.learned(docs, labels)).collect() if r.predicted}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    good = {r.doc_id for r in quality.score_documents(docs, quality.learned(docs, labels)).collect() if r.predicted}
    assert {r.doc_id for r in stages["quality"](spark, docs, folder).collect()} == good
    first = [r.doc_id for r in ngram_join.classes_of(docs).collect() if r.doc_id == r.component_id]
    single = stages["ngram_jaccard"](spark, docs, folder)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(first)
    masked = stages["pii"](spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert {r.doc_id for r in stages["packing"](spark, masked, folder).collect()} == {r.doc_id for r in docs.collect()}


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "x"), (None, None, "x"), (3, None, "x")], "doc_id long, text string, part string")
    out = pipeline.one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text) == [(1, "a b c d e f")] and out.count() == 3
    assert pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0
    assert pipeline.pack_sequences(spark, docs.limit(0), "").count() == 0


def test_workers_keep_no_chunks_after_packing(spark):
    docs = spark.createDataFrame([(1, "first zqleftover word", "x")], "doc_id long, text string, part string")
    assert pipeline.pack_sequences(spark, docs, "").count() == 1

    def probe(frames):
        for frame in frames:
            known = [c for c in common._encoders.values() if any(" zqleftover" in t or "zqleftover" in t for t in (c.recent, c.older))]
            yield pd.DataFrame({"known": [len(known)] * len(frame)})

    assert {r.known for r in spark.range(64, numPartitions=64).mapInPandas(probe, "known int").collect()} == {0}


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(0, 4000, numPartitions=1).selectExpr("id as doc_id", "'call +1 212 555 0100 x' as text")
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        masked = dict(pipeline.STAGES)["pii"](spark, docs, "")
        sizes = {r.n for r in masked.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n int").collect()}
        assert max(sizes) <= pipeline.BATCH_ROWS and masked.where("text like '%<PHONE>%'").count() == 4000
        spark.conf.set(name, "10")
        dict(pipeline.STAGES)["pii"](spark, docs, "")
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)
