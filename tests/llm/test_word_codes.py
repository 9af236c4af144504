"""Character codes of many words at once against one word at a time, and scores that do not depend on how texts are dealt."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import toxicity


def plain_codes(word):
    code = lambda c: 1 + ord(c) % (toxicity.CHARS - 1)
    head, tail = word[: toxicity.EDGE], word[-toxicity.EDGE :]
    missing = [0] * (toxicity.EDGE - len(head))
    return [*map(code, head), *missing, *missing, *map(code, tail)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(categories=("L", "N")), max_size=12), min_size=1, max_size=30))
def test_codes(words):
    assert toxicity.char_codes(words).tolist() == [plain_codes(w) for w in words]


def test_scores_do_not_depend_on_the_block():
    net = toxicity.fresh(3, 1)
    vocabulary = {"alpha": 1, "beta": 2, "gamma": 3}
    texts = ["", "alpha beta", "gamma " * 700, "x" * 5000, "einwort漢字 " * 90]
    together = toxicity.Scorer(net, vocabulary)(texts)
    alone = [toxicity.Scorer(net, vocabulary)([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_no_texts():
    assert len(toxicity.Scorer(toxicity.fresh(0, 1), {})([])) == 0
