"""Personal data against plain patterns, against every segmentation, and on sentences that were not trained on."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np

from strandwise.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def kept(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if kept(k, m[0]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    bits = ["a@b.c", "@", ".", "..", "1.2.3.4", "256", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111", " ", "-", "+", "+44 20 79", "(0)", "7", "12", "é", "\n", "x%y", "_", "1.1.1.1.1", "@-.-", "9" * 14, "0" * 19]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_the_best_segmentation_is_found():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        every = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        found = [(i, j, tuple(sorted(rng.sample(range(4), rng.randint(1, 3))))) for i, j in rng.sample(every, min(len(every), rng.randint(1, 7)))]
        scores = np.array([[rng.uniform(-2, 3) for _ in range(4)] for _ in found])
        best = 0.0
        total = 0.0
        counts = np.zeros(scores.shape)
        for size in range(len(found) + 1):
            for chosen in combinations(range(len(found)), size):
                spans = sorted(found[c][:2] for c in chosen)
                if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
                    continue
                best = max(best, sum(max(scores[c, k] for k in found[c][2]) for c in chosen))
                mass = float(np.prod([sum(np.exp(scores[c, k]) for k in found[c][2]) for c in chosen]))
                total += mass
                for c in chosen:
                    own = sum(np.exp(scores[c, k]) for k in found[c][2])
                    for k in found[c][2]:
                        counts[c, k] += mass / own * np.exp(scores[c, k])
        out = pii.decode(n, found, scores)
        at = {f[:2]: s for s, f in enumerate(found)}
        assert abs(sum(scores[at[i, j], k] for i, j, k in out) - best) < 1e-9
        assert np.allclose(pii.marginals(n, found, scores), counts / total)


def test_sentences_not_trained_on():
    for kind, (precision, recall) in pii.measured(99, 600, pii.trained()).items():
        assert precision >= 0.95 and recall >= 0.93, kind


def test_look_alikes_are_left_alone():
    weights, rng = pii.trained(), random.Random(6)
    for text in ("meet at noon dot com", "call me at home. Then go", "order 4111 1111 1111 1112 is late", "the river. At, thre erenwh, only. Anhe"):
        assert pii.all_spans(text, weights)[1] == []
    for _ in range(300):
        n = rng.randint(14, 19)
        number = "".join(rng.choice("0123456789") for _ in range(n))
        text = "number " + rng.choice((number, " ".join(number[i : i + 4] for i in range(0, n, 4)))) + " here"
        for a, k, b in pii.all_spans(text, weights)[1]:
            assert k == 2 and pii.luhn(text[a:b].replace(" ", "")) and 13 <= len(text[a:b].replace(" ", ""))
    assert pii.all_spans("ask john dot doe at example dot com today", weights)[1] == [(4, 0, 35)]


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    schema = "doc_id long, text string, spans string, n_email long, n_chars long"
    rows = [(1, "to a@b.org", "x", 9, 10)] * 2 + [(None, "to a@b.org", None, None, None), (2, None, "", 0, 0), (3, "", "", 0, 0), (4, "word 7 " * 100_000 + "a@b.org", "", 0, 0)]
    frame = spark.createDataFrame(rows, schema)
    found = pii.find(frame).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 1)]
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" for r in found if r.doc_id in (2, 3))
    assert pii.find(frame.limit(0)).count() == 0 and pii.redacted(frame.limit(0), frame.columns).count() == 0
    masked = pii.redacted(frame, frame.columns).collect()
    assert sorted(r.text for r in masked if r.doc_id == 1) == ["to <EMAIL>"] * 2 and all(r.spans == "x" for r in masked if r.doc_id == 1)
