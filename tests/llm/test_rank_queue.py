"""The rank queue, filled at once from a table of byte pairs, against a plain loop."""

import random

from strandwise.llm.bpe import Bpe


def plain(ranks, data):
    parts = [bytes([b]) for b in data]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks.get(p, -1) for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_same_ids_as_a_plain_loop():
    draw = random.Random(7)
    ranks = {bytes([b]): b for b in range(250)}
    for rank in range(250, 900):
        ranks.setdefault(bytes(draw.choices(b"abcd", k=draw.randint(2, 5))), rank)
    bpe = Bpe(ranks, ".")
    for size in [1, 2, 3, *range(4, 120)]:
        data = bytes(draw.choices(b"abcd\xfe\xff", k=size))
        assert bpe.merge(data) == plain(ranks, data)
    words = [bytes(draw.choices(b"abcd", k=draw.randint(1, 30))) for _ in range(300)]
    assert bpe.merge_all(words) == [[ranks[w]] if w in ranks else plain(ranks, w) for w in words]
