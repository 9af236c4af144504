"""Token counts against the library itself."""

import public_tokenizers
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def counted(docs, limit):
    from strandwise.llm.token_counts import token_counts

    return sorted((tuple(r) for r in token_counts(docs, PATH, public_tokenizers.PATTERN, limit).collect()), key=str)


ODD = [
    "",
    None,
    "a<|endoftext|>b <|endoftext|><|endoftext|> c",
    "<|endoftext|>",
    "<|endoftext| >",
    "it's they'll  WE'VE\n\n\n x\t\ty   z  ",
    "a՘b ࢏౜ 1⃁ \U00010940\U00010941",
    "é 你好，世界 \U0001f600\U0001f44d\U0001f3fd ١٢٣",
    "x" * 70_000,
    " ".join(["word"] * 30_000),
    "z" * 65 + " " + "z" * 65,
    "\r\n\x0b\x0c\x1c\x85  end",
]


def test_counts_are_those_of_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "no number"), (None, None), (7, "another text of that number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("key"), F.lit(1).alias("n"), F.lit(2).alias("row"), F.lit(3).alias("known"), F.lit(4).alias("pieces"))
    assert counted(docs, 20) == plain(rows, 20)


def test_rare_pre_tokens_are_joined(spark, small, monkeypatch):
    from strandwise.llm import token_counts

    monkeypatch.setattr(token_counts, "FREQUENT", 50)
    monkeypatch.setattr(token_counts, "HELD", 100)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert counted(docs, 512) == plain([(r.doc_id, r.text) for r in docs.collect()], 512)


def test_empty_table(spark):
    assert counted(spark.createDataFrame([], "doc_id long, text string"), 5) == []
