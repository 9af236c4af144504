"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F


def plain(rows, depth, least, scale, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p for p, n in f.items() if len(p) > 1 and n >= least}
        inside = set()
        for q in candidates:
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    p = q[i:j]
                    if len(p) < len(q) and f[q] >= f[p]:
                        inside.add(p)
        rows = []
        for p in candidates - inside:
            a, n = f[p], totals[lang]
            score, k = min((scale * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        for rank, r in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, r[2].decode(), *r[3:]))
    return sorted(out)


def found(docs, **how):
    from strandwise.llm.collocations import collocations

    return sorted(tuple(r) for r in collocations(docs, **how).collect())


def random_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "STRASSE", "straße", " x", "q\x1cr"]
    rows = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append("the same old few words again" if rng.random() < 0.05 else rng.choice(words[: rng.choice([3, 8, 30])]))
            text.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n"]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(text)))
    return [*rows, ("en", None), ("en", ""), ("fr", "..."), ("en", "again " * 3000), ("de", "A a A a. A a")]


@pytest.mark.parametrize(("least", "first", "shard"), [(2, 2000, 200_000), (5, 7, 50)])
def test_collocations_are_those_of_plain_counting(spark, monkeypatch, least, first, shard):
    from strandwise.llm import collocations

    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "HELD", 20)
    rows = random_rows(least)
    docs = spark.createDataFrame([(i % 9, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string").select("*", F.lit("x").alias("phrase"), F.lit(1).alias("f"), F.lit(2).alias("n"))
    assert found(docs, least=least, first=first) == plain(rows, 5, least, 1000, first)


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    from strandwise.llm import collocations

    monkeypatch.setattr(collocations, "TABLE_BITS", (6, 6))
    rows = random_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=3) == plain(rows, 5, 3, 1000, 2000)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs) == plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 5, 100, 1000, 2000)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "lang string, text string")) == []


def test_automaton_counts_every_phrase():
    from strandwise.llm.collocations import SuffixAutomaton

    rng = random.Random(1)
    for letters in (1, 2, 5):
        automaton, seen, expected = SuffixAutomaton(), [], Counter()
        for _ in range(20):
            run = [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
            automaton.add(run, len(seen))
            seen += run
            for k in range(2, 6):
                expected.update(tuple(run[i : i + k]) for i in range(len(run) - k + 1))
        got = [(tuple(seen[a : a + k]), n) for k, begins, counts in automaton.phrases(5) for a, n in zip(begins.tolist(), counts.tolist())]
        assert len(got) == len(dict(got)) and dict(got) == dict(expected)
