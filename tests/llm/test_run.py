"""run() against plain versions of its last three stages, with labels of one class so that the networks keep every row."""

import re
import zlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from test_llm import brute_classes


def test_run_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    base = " ".join(f"word{i}" for i in range(80))
    texts = [base, base + " more", base.upper(), "mail ann.b@mail.example.org now please", "", None, "quite another text of seven words", "mail ann.b@mail.example.org now please"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = set()
    for i, (_, top) in brute_classes(list(enumerate(texts))).items():
        if i == top:
            text = re.sub(r"[a-z.]+@[a-z.]+[a-z]", "<EMAIL>", texts[i] or "")
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
            expected.add((i, 0, len(ids), zlib.crc32(ids.tobytes())))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected) < len(texts)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([length for _, length in sorted(places)])
        assert [offset for offset, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_networks_on_null_empty_and_repeated_rows(spark):
    from strandwise.llm import quality, toxicity

    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, "some text"), (2, None), (3, "")], "doc_id long, text string")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        labels = spark.createDataFrame([], f"doc_id long, {label} int")
        rows = module.score_documents(docs, module.learned(docs, labels)).collect()
        assert len(rows) == 5 and all(abs(r.score - 0.5) < 1e-6 for r in rows) and sum(r.doc_id is None for r in rows) == 1
