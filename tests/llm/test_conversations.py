"""Repaired conversations against a plain search over (cost, audit)."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

MADE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def fits(state, initial):
    return (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def cheapest(facts):
    """Least (cost, audit) of edits that leave initials fitting (s?(ua)+)?, all states carried along."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                to = MADE[state][0]
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, must_go, cut in facts:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, "D")]
            if not must_go:
                ways.append((MADE[state][0], cost + 2 + cut, "R"))
                if fits(state, initial):
                    ways.append((initial, cost + cut, "K"))
            for to, total, edit in ways:
                after[to] = min(after.get(to, (10**9, "")), (total, audit + edit))
        best = inserted(after)
    return min(best[state] for state in ("", "a") if state in best)


def plain(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs.setdefault(conv_id, [])
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
        kept += [(turn is not None, turn or 0, role, digest, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, kept in convs.items():
        kept.sort()
        seen, facts, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in kept:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(facts)
        turns = {r[1] for r in kept if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0], b[0]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(facts, facts[1:]))
        left, state, i = [], "", 0
        for edit in audit:
            if edit == "I":
                left.append(MADE[state] + ":")
            elif edit == "R":
                left.append(f"{MADE[state]}:{kept[i][4]}")
            elif edit == "K":
                left.append(f"{kept[i][2]}:{kept[i][4]}")
            state = state if edit == "D" else kept[i][2][0] if edit == "K" else MADE[state][0]
            i += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left))
        out.append((conv_id, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows):
    from strandwise.llm.conversations import repair

    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("x").alias("digest"), F.lit(1).alias("copy"), F.lit(2).alias("part"), F.lit(3).alias("audit"))
    return sorted((tuple(r) for r in repair(table).collect()), key=str)


def made_up(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "so", "", None, " \t", "One. Two", "Why? ", " ", "end. ", "x.\n"]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 12))]
    hot = [(77, t, rng.choice(roles[:6]), rng.choice(texts) if rng.random() < 0.3 else f"text {t}.") for t in range(900)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return rows + hot + rows[:9] + [(dropped, 1, "user", "Hello."), (5, 3, "user", "long " * 50_000 + ".")]


@pytest.mark.parametrize("strip", [20_000, 7])
def test_repair_is_the_cheapest(spark, monkeypatch, strip):
    from strandwise.llm import conversations

    monkeypatch.setattr(conversations, "STRIP", strip)
    rows = made_up(strip)
    assert repaired(spark, rows) == plain(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == []
