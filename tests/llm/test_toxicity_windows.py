"""Both layers read at once against one after the other, words cut together against one by one, and the vocabulary projected once."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import toxicity


def plain_logit(net, words, known):
    """One window, read as gradients() does, of inputs projected on their own."""
    pad = np.arange(toxicity.WINDOW)[:, None] >= len(words)
    filled = words + [""] * (toxicity.WINDOW - len(words))
    flat = toxicity.inputs(net, np.array([known.get(w, 0) for w in filled]), toxicity.char_codes(filled))
    x = ((flat @ net["project"] + net["offset"]) * ~pad)[:, None]
    half = 3 * toxicity.HIDDEN
    states = np.concatenate([toxicity.read(net, "f", x[..., :half])[0], toxicity.read(net, "b", x[..., half:])[0]], axis=2)
    weight = np.exp(states @ net["attend"] - 30.0 * pad)
    return float(((states * weight[..., None]).sum(axis=0) / weight.sum(axis=0)[:, None] @ net["out"] + net["shift"][0])[0])


def plain_score(net, text, vocabulary):
    words = [x for w in toxicity.WORD.findall(text.lower()) for x in toxicity.inputs_of(w, vocabulary)]
    starts = [*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE), *([len(words) - toxicity.WINDOW] if len(words) > toxicity.WINDOW else [])]
    return 1 / (1 + np.exp(-max(plain_logit(net, words[s : s + toxicity.WINDOW], vocabulary) for s in starts)))


def test_scores_are_those_of_one_window_at_a_time():
    vocabulary = {"alpha": 1, "beta": 2, "wholelongword": 3, "einlange": 4}
    net = toxicity.fresh(4, 5)
    texts = ["", "alpha", "Alpha beta " * 16, "beta x " * 16 + "end", "wholelongword einlangeswort " * 30, "漢字" * 90 + " 𝒳𝒴𝒵 a_b", "z9 " * 700, "alpha beta"]
    assert np.allclose(toxicity.Scorer(net, vocabulary)(texts), [plain_score(net, t, vocabulary) for t in texts], atol=1e-5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.characters(categories=("L", "N")), min_size=1, max_size=40), st.booleans()), max_size=20))
def test_cuts(words):
    text = "".join(w for w, _ in words)
    counts, begins, ends = toxicity.cuts(np.array([len(w) for w, _ in words], np.int64), np.array([k for _, k in words], bool))
    expected = [toxicity.inputs_of(w, {w} if k else ()) for w, k in words]
    assert counts.tolist() == [len(x) for x in expected]
    assert [text[a:b] for a, b in zip(begins, ends)] == [x for xs in expected for x in xs]


def test_vocabulary_is_projected_once_though_other_words_are_forgotten(monkeypatch):
    """Before, all words were forgotten together, so that common ones were cut and projected again at every other batch."""
    monkeypatch.setattr(toxicity, "REMEMBERED", 64)
    projected, inputs = [], toxicity.inputs
    monkeypatch.setattr(toxicity, "inputs", lambda net, word_rows, chars: projected.extend(word_rows.tolist()) or inputs(net, word_rows, chars))
    vocabulary = {f"word{i}": i for i in range(1, 11)}
    net = toxicity.fresh(10, 1)
    scorer = toxicity.Scorer(net, vocabulary)
    texts = [" ".join([*vocabulary, *(f"rare{k}x{i}" for i in range(n))]) for k, n in enumerate([30, 30, 30, 200, 5, 30])]
    scores = [scorer([t])[0] for t in texts]
    assert sum(k > 0 for k in projected) == len(vocabulary)
    assert len(scorer.projected) == 64
    monkeypatch.undo()
    assert np.allclose(scores, toxicity.Scorer(net, vocabulary)(texts), atol=1e-5)
