"""Long texts: what the pipeline's reader, the labelled sample and the quality network hold of them at once."""

import tracemalloc

import corpus_pipeline as pipeline
import numpy as np
from strandwise.llm import quality
from strandwise.llm.common import labelled_sample


def test_few_rows_are_read_at_once(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, part string")
    before = spark.conf.get(name)
    try:
        for given, most in (("4096", pipeline.READ_ROWS), ("10", 10)):
            spark.conf.set(name, given)
            assert dict(pipeline.STAGES)["pii"](spark, docs, "").count() == 1
            assert int(spark.conf.get(name)) == most
    finally:
        spark.conf.set(name, before)


def test_the_labelled_sample_is_bounded_by_its_texts(spark):
    docs = spark.createDataFrame([(i, str(i) * (300 if i % 10 == 0 else 5)) for i in range(1, 400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    whole = labelled_sample(docs, labels, "toxic", 200, 1)
    few = labelled_sample(docs, labels, "toxic", 200, 1, most=1000)
    assert sum(len(t) for t, _ in whole) > 1000 and labelled_sample(docs, labels, "toxic", 200, 1, most=10**6) == whole
    assert few == labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", 200, 1, most=1000) and set(few) < set(whole)
    for y in (0, 1):
        assert 450 < sum(len(t) for t, label in few if label == y) <= 500
    one = labelled_sample(docs, labels, "toxic", 200, 1, most=2)
    assert sorted(y for _, y in one) == [0, 1]  # no class is lost when none of its texts fits


def test_a_long_text_is_scored_in_blocks(monkeypatch):
    draw = np.random.default_rng(3)
    net = quality.constant(0.5) | {k: draw.normal(0, 0.3, v.shape).astype(np.float32) for k, v in quality.constant(0.5).items()}
    texts = ["", "short", "x" * 2000, "".join(map(chr, draw.integers(32, 127, 5000))), "y z " * 40]
    whole = quality.scores(net, texts)
    monkeypatch.setattr(quality, "BLOCK", 17)
    assert np.allclose(quality.scores(net, texts), whole, atol=1e-6)
    monkeypatch.undo()
    tracemalloc.start()
    try:
        assert 0 <= quality.scores(net, ["one two three " * 600_000])[0] <= 1
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()
