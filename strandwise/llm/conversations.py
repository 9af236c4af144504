"""Repair of conversations by cheapest edits: Dial's shortest paths over (row, role state).

A conversation's roles must read `(s?(ua)+)?` by their initials. The states are: nothing yet, after the
system row, after a user row, after an assistant row; the first and the last may end it. Keep costs 0, Rerole to
user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert of an empty user or assistant
row 2; a truncated row that is not deleted adds 1. In each state only one of user and assistant fits, so an
edit's initial says what it does.

1. Rows are dealt by ranges of (conv_id, turn, ...) and sorted, so a conversation, however long, is spread over
   tasks. A task reads its range once and cuts it into strips of one conversation of at most STRIP rows
   or STRIP_CHARS characters.
2. Distances to the end: all arc costs are at most 3, so open nodes wait in Dial's ring of four buckets. A
   conversation that lies in one strip, away from the borders of the range, is finished at once. Of another
   strip, distances to each of the four states behind it are kept: a 4 x 4 table, whatever its length.
3. The tables of a conversation, last strip first, give the distances behind each strip (sixteen numbers a strip).
   With these each strip is walked from each of the four states, taking at every node the tight arc
   of least initial: the audit. The strips in order tell which of the four walks is the one.
4. What is left is hashed in order, streaming, a strip at a time.

Order: turn (null first), then role, a digest of role and text, and whether the row is an adjacent repeat; so
rows of one turn have a defined order, and equal rows stand side by side. Null role or text is one space, so
is a null conv_id or turn in the damage's name; null conv_ids are one conversation. A conversation all of
whose rows are dropped has zeros, an empty audit and the hash of the empty string. An empty table gives an empty one. Equal
rows of one turn are in one task, read as a stream. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import partitions, utf8
from strandwise.session import written

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of this initial, for each state.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What an inserted or reroled row is, for each state.
MADE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ADDED = {state: STEP[role[0]][state] for state, role in MADE.items()}
ENDS = (0, None, None, 0)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than the greatest cost of one arc: the buckets of the ring.
RING = 4
STRIP, STRIP_CHARS = 20_000, 4_000_000
#: Groups that the first turns of repeated rows are dealt to.
SALTS = 16
UNREACHED = 1 << 60


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (1: an adjacent repeat) and gone (dropped) of each row after the damage."""

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(named("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
        (kind == 0).alias("gone"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"), "gone")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds blank, cut (the last visible character ends no sentence) and later: an equal row has an earlier turn."""
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    visible = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.select(
        "*",
        (F.length(visible) == 0).alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"),
        turn.alias("at"),
    )
    firsts = rows.where(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(F.col("first") < F.col("last"))
    salted = firsts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    same = rows["conv_id"].eqNullSafe(salted["conv_id"]) & (rows["digest"] == salted["digest"]) & (rows["salt"] == salted["salt"])
    met = rows.join(salted, same, "left")
    later = F.coalesce(rows["at"] > salted["first"], F.lit(False)).alias("later")
    return met.select(rows["conv_id"], "turn", "role", "text", "copy", "gone", "blank", "cut", later, rows["digest"])


def distances(facts: list[tuple[str, bool, bool]], behind: list[int | None]) -> list[list[int]]:
    """For every row and state, and for the end, the least cost from there to what lies behind, by Dial's buckets.

    facts: each row's (role initial, must go, is truncated); behind: the cost in each state at the end.
    """
    n = len(facts)
    best = [[UNREACHED] * 4 for _ in range(n + 1)]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(RING)]
    starts = sorted((cost, state) for state, cost in enumerate(behind) if cost is not None)
    waiting, level = 0, starts[0][0] if starts else 0
    while starts or waiting:
        while starts and starts[0][0] == level:
            _, state = starts.pop(0)
            if level < best[n][state]:
                best[n][state] = level
                ring[level % RING].append((n, state))
                waiting += 1
        bucket = ring[level % RING]
        while bucket:
            i, state = bucket.pop()
            waiting -= 1
            if best[i][state] != level:
                continue
            arcs = [(i, p, INSERT) for p in range(4) if ADDED[p] == state]
            if i:
                initial, must_go, cut = facts[i - 1]
                arcs.append((i - 1, state, DELETE))
                if not must_go:
                    arcs += [(i - 1, p, cut * TRUNCATED) for p, to in STEP.get(initial, {}).items() if to == state]
                    arcs += [(i - 1, p, REROLE + cut * TRUNCATED) for p in range(4) if ADDED[p] == state]
            for j, p, cost in arcs:
                if level + cost < best[j][p]:
                    best[j][p] = level + cost
                    ring[(level + cost) % RING].append((j, p))
                    waiting += 1
        level += 1
    return best


def walk(facts: list[tuple[str, bool, bool]], best: list[list[int]], behind: list[int | None], state: int) -> tuple[int, str]:
    """From a state before the first row along tight arcs, the least initial at each: (state behind, audit)."""
    n, i, audit = len(facts), 0, []
    while i < n or best[n][state] != behind[state]:
        left, to = best[i][state], ADDED[state]
        if i < n:
            initial, must_go, cut = facts[i]
            kept = STEP.get(initial, {}).get(state)
            if left == best[i + 1][state] + DELETE:
                i += 1
                audit.append("D")
            elif left == best[i][to] + INSERT:
                state = to
                audit.append("I")
            elif not must_go and kept is not None and left == best[i + 1][kept] + cut * TRUNCATED:
                i, state = i + 1, kept
                audit.append("K")
            else:
                i, state = i + 1, to
                audit.append("R")
        else:
            state = to
            audit.append("I")
    return state, "".join(audit)


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[str]:
    """The rows `role:text` that an audit leaves, from a state."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            out.append(MADE[state] + ":")
            state = ADDED[state]
            continue
        if edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = STEP[roles[i][0]][state]
        elif edit == "R":
            out.append(f"{MADE[state]}:{texts[i]}")
            state = ADDED[state]
        i += 1
    return out


class Strip:
    """Neighbouring rows of one conversation, as they are read."""

    def __init__(self, conv_id: int | None, whole: bool):
        self.conv_id, self.whole = conv_id, whole
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.facts: list[tuple[str, bool, bool]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_turn: int | None = None
        self.last_turn: int | None = None
        self.chars = 0

    def add(self, role: str, text: str, turn: int | None, fault: str) -> None:
        initial = role[:1]
        if self.facts and (self.facts[-1][0], initial) not in LEGAL:
            self.counts["illegal"] += 1
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.roles.append(role)
        self.texts.append(text)
        self.facts.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        self.chars += len(text) + len(role)

    def row(self, part: int, seq: int) -> dict:
        """A finished conversation (audit and hash), or what the next steps need of a strip."""
        out = {"conv_id": self.conv_id, "part": part, "seq": seq, "whole": self.whole, **self.counts}
        out |= {"first_turn": self.first_turn, "last_turn": self.last_turn, "rows": len(self.facts)}
        out |= dict.fromkeys(("cost", "audit", "repaired_sha256", "roles", "texts", "go", "cuts", "table"))
        if self.whole:
            best = distances(self.facts, list(ENDS))
            _, out["audit"] = walk(self.facts, best, list(ENDS), START)
            out["cost"] = best[0][START]
            out["repaired_sha256"] = hashlib.sha256(utf8("\n".join(repaired(self.roles, self.texts, out["audit"], START)))).hexdigest()
        else:
            out |= {"roles": self.roles, "texts": self.texts, "go": [f[1] for f in self.facts], "cuts": [f[2] for f in self.facts]}
            out["table"] = [d if d < UNREACHED else None for d in transfer(self.facts)]
        return out


def transfer(facts: list[tuple[str, bool, bool]]) -> list[int]:
    """The least cost from each state before the rows (first index) to each state behind them."""
    columns = [distances(facts, [0 if state == end else None for state in range(4)])[0] for end in range(4)]
    return [columns[end][begin] for begin in range(4) for end in range(4)]


COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long"
STRIPS = f"conv_id long, part int, seq int, whole boolean, {COUNTS}, first_turn long, last_turn long, rows long, cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>, go array<boolean>, cuts array<boolean>, table array<long>"


def as_int(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def framed(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame whose long columns may hold nulls."""
    names = [part.split() for part in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in names], dtype=object)
    for name, kind in names:
        if kind in ("long", "int"):
            frame[name] = frame[name].astype("Int64")
    return frame


def strips(rows: DataFrame) -> DataFrame:
    """The rows of with_faults as finished conversations and as strips of those that a border may cut."""
    n = partitions(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("copy").asc())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        strip, before, begun, out, chars = None, None, False, [], 0

        def close(whole: bool) -> None:
            nonlocal seq, chars
            strip.whole = whole and strip.whole
            out.append(strip.row(part, seq))
            chars += strip.chars
            seq += 1

        for frame in frames:
            columns = [frame[c].tolist() for c in ("role", "text", "gone", "blank", "cut", "later", "digest")]
            for conv_id, turn, role, text, gone, blank, cut, later, digest in zip(map(as_int, frame["conv_id"]), map(as_int, frame["turn"]), *columns):
                if strip is None or conv_id != strip.conv_id:
                    if strip is not None:
                        close(whole=True)
                    strip, before = Strip(conv_id, whole=begun), None
                    begun = True
                elif len(strip.facts) >= STRIP or strip.chars >= STRIP_CHARS:
                    close(whole=False)
                    strip = Strip(conv_id, whole=False)
                if gone:
                    continue
                same, before = (turn, digest) == before, (turn, digest)
                fault = "blank" if blank else "duplicate" if later or same else "truncated" if cut else ""
                strip.add(role, text, turn, fault)
                if len(out) >= 2000 or chars > STRIP_CHARS:
                    yield framed(out, STRIPS)
                    out, chars = [], 0
        if strip is not None:
            close(whole=False)
        if out:
            yield framed(out, STRIPS)

    return dealt.mapInPandas(run, STRIPS)


def streamed(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Strips dealt by conversation, each conversation's in order."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("part", "seq")]
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def distances_behind(cut: DataFrame) -> DataFrame:
    """part, seq and behind: the least cost from each state behind a strip to the conversation's end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, own, behind = False, None, list(ENDS)
        for frame in frames:
            out = []
            for conv_id, part, seq, table in zip(map(as_int, frame["conv_id"]), frame["part"], frame["seq"], frame["table"]):
                if not begun or conv_id != own:
                    begun, own, behind = True, conv_id, list(ENDS)
                out.append({"part": part, "seq": seq, "behind": behind})
                costs = [[table[4 * a + b] + behind[b] for b in range(4) if not pd.isna(table[4 * a + b]) and behind[b] is not None] for a in range(4)]
                behind = [int(min(c)) if c else None for c in costs]
            yield framed(out, "part int, seq int, behind array<long>")

    return streamed(cut.select("conv_id", "part", "seq", "table"), descending=True).mapInPandas(run, "part int, seq int, behind array<long>")


WALKED = f"conv_id long, part int, seq int, {COUNTS}, first_turn long, last_turn long, rows long, head string, tail string, costs array<long>, exits array<int>, audits array<string>"


def walked(cut: DataFrame, behind: DataFrame) -> DataFrame:
    """Each strip's cost to the end, state behind it and audit, from each of the four states before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                facts = list(zip([r[:1] for r in row["roles"]], map(bool, row["go"]), map(bool, row["cuts"])))
                after = [as_int(x) for x in row["behind"]]
                best = distances(facts, after)
                walks = [walk(facts, best, after, s) if best[0][s] < UNREACHED else (s, "") for s in range(4)]
                row |= {"head": facts[0][0] if facts else None, "tail": facts[-1][0] if facts else None, "costs": best[0], "exits": [w[0] for w in walks], "audits": [w[1] for w in walks]}
                out.append(row)
            yield framed(out, WALKED)

    return cut.join(behind, ["part", "seq"]).mapInPandas(run, WALKED)


def joined_up(walks: DataFrame) -> DataFrame:
    """Per strip the state before it and its audit; and in each conversation's last strip the sums of the conversation."""
    schema = f"conv_id long, part int, seq int, state int, audit string, {COUNTS}, first_turn long, last_turn long, cost long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, own = False, None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                conv_id, first, last = as_int(row["conv_id"]), as_int(row["first_turn"]), as_int(row["last_turn"])
                if not begun or conv_id != own:
                    begun, own, state, tail, turn = True, conv_id, START, None, None
                    cost = int(row["costs"][START])
                else:
                    cost = None
                row["state"], row["audit"], row["cost"] = state, row["audits"][state], cost
                if row["rows"]:
                    row["illegal"] += tail is not None and (tail, row["head"]) not in LEGAL
                    row["turns"] -= turn is not None and turn == first
                    tail = row["tail"]
                turn = turn if last is None else last
                state = int(row["exits"][state])
                out.append(row)
            yield framed(out, schema)

    return streamed(walks).mapInPandas(run, schema)


def hashed(cut: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, audit and hash of what the audits leave, read strip by strip in order."""

    def leave(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left = ["\n".join(repaired(list(r), list(t), a, s)) for r, t, a, s in zip(frame["roles"], frame["texts"], frame["audit"], frame["state"])]
            kept = [sum(e != "D" for e in a) for a in frame["audit"]]
            yield framed([{"conv_id": c, "part": p, "seq": q, "audit": a, "left": x, "kept": k} for c, p, q, a, x, k in zip(frame["conv_id"], frame["part"], frame["seq"], frame["audit"], left, kept)], "conv_id long, part int, seq int, audit string, left string, kept long")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, own, found, audit, some = False, None, hashlib.sha256(), [], False
        for frame in frames:
            out = []
            for conv_id, text, part, kept in zip(map(as_int, frame["conv_id"]), frame["left"], frame["audit"], frame["kept"]):
                if begun and conv_id != own:
                    out.append({"conv_id": own, "audit": "".join(audit), "repaired_sha256": found.hexdigest()})
                    found, audit, some = hashlib.sha256(), [], False
                begun, own = True, conv_id
                if kept:
                    found.update(utf8("\n" + text if some else text))
                    some = True
                audit.append(part)
            if out:
                yield framed(out, "conv_id long, audit string, repaired_sha256 string")
        if begun:
            yield framed([{"conv_id": own, "audit": "".join(audit), "repaired_sha256": found.hexdigest()}], "conv_id long, audit string, repaired_sha256 string")

    texts = cut.select("part", "seq", "roles", "texts").join(chosen.select("conv_id", "part", "seq", "state", "audit"), ["part", "seq"])
    left = texts.mapInPandas(leave, "conv_id long, part int, seq int, audit string, left string, kept long")
    return streamed(left).mapInPandas(digest, "conv_id long, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conv_id: gaps, faults, illegal neighbours, cost, audit and hash of the repaired conversation."""
    # Strip numbers are a matter of how the rows were dealt; written once, they stay.
    found = written(strips(with_faults(damaged(conversations))), "conversation-strips")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = found.where("whole").withColumn("gaps", gaps).select(*names)
    cut = found.where("NOT whole")
    chosen = written(joined_up(walked(cut, distances_behind(cut))), "conversation-walks")
    sums = chosen.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
        F.max("cost").alias("cost"),
    )
    texts = hashed(cut, chosen).withColumnRenamed("conv_id", "own_id")
    parted = sums.join(texts, sums["conv_id"].eqNullSafe(texts["own_id"])).withColumn("gaps", gaps).select(*names)
    return whole.unionAll(parted)
