"""Growing k-mers: windows of rising size, of which the first that is not repetitive decides.

A ladder is an array of strings made from a read by the functions below, all as Column expressions; a window is left
out if it can't be cut from the read. `decided` looks up the first window of each ladder in a table of k-mers, and only
ladders whose first window is repetitive are looked up whole, in a second join; nothing loops over rounds.

The table has kmer, class and any further columns for every size on the ladders (`longest` bounds them); a k-mer
without a row is UNTRUSTED. Positions count from 0; sequences are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import part_of, undo_error
from strandwise.operators.counting import positions
from strandwise.session import written

#: Window sizes of ladders, which need tables of classes for all of them, stop here unless told otherwise; grown_starts has no such bound.
LONGEST = 21


def _whole(windows: Column) -> Column:
    """Without windows that hold an underscore."""
    return F.filter(windows, lambda w: ~w.contains("_"))


def _steps(count: Column) -> Column:
    """0 to count - 1, empty below 1."""
    return F.when(count >= 1, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _rungs(room: Column, k: int, longest: int) -> Column:
    """How many of the sizes k, k + 2 ... longest fit into so many bases."""
    return F.when(room >= k, F.floor((F.least(room, F.lit(longest)) - k) / 2) + 1).otherwise(0)


def left_of(seq: Column, pos: Column, k: int, longest: int = LONGEST) -> Column:
    """Windows that end right before pos."""
    each = F.transform(_steps(_rungs(pos, k, longest)), lambda i: part_of(seq, pos - (k + 2 * i), (k + 2 * i).cast("int")))
    return _whole(each)


def right_of(seq: Column, pos: Column, k: int, longest: int = LONGEST) -> Column:
    """Windows that start right behind pos."""
    room = F.length(seq) - pos - 1
    return _whole(F.transform(_steps(_rungs(room, k, longest)), lambda i: part_of(seq, pos + 1, (k + 2 * i).cast("int"))))


def _run_without_gap(s: Column) -> Column:
    return F.length(F.substring_index(s, "_", 1))


def middle(seq: Column, pos: Column, instead: Column, k: int, longest: int = LONGEST) -> Column:
    """Windows of odd size around `instead`, which stands where the base at pos is; they grow by a base on the left and on the right in turn.

    A side ends at the read's end or at an underscore; then the other grows alone.
    """
    left = F.reverse(F.substring_index(F.reverse(part_of(seq, F.lit(0), pos.cast("int"))), "_", 1))
    right = F.substring_index(part_of(seq, pos + 1, F.length(seq)), "_", 1)
    a, b, m = F.length(left), F.length(right), F.length(instead)
    most = F.least(a + b, F.lit(longest) - m, F.length(seq) - m)

    def window(t: Column) -> Column:
        t = t + 1
        from_left = F.least(a, F.greatest(F.ceil(t / 2).cast("int"), t - b))
        return F.concat(F.right(left, from_left), instead, F.left(right, (t - from_left).cast("int")))

    each = F.transform(_steps(most), window)
    return F.filter(each, lambda w: (F.length(w) >= k) & (F.length(w) % 2 == 1))


def onward(seq: Column, pos: Column, k: int, longest: int = LONGEST, first: bool = True) -> Column:
    """Windows from pos that grow by two on the right, then, from the longest of these, by two on the left.

    With first, the window of size k leads. A read that ends before k bases from pos gives its last k bases and what
    lies before them.
    """
    size = F.length(seq)
    start = F.least(pos, size - k)
    n = _rungs(size - start, k, longest)
    right = F.transform(_steps(n), lambda i: part_of(seq, start, (k + 2 * i).cast("int")))
    reach = start + k + 2 * (n - 1)
    more = F.least(F.floor(start / 2), F.floor((F.lit(longest) - (reach - start)) / 2))
    left = F.transform(_steps(more), lambda i: part_of(seq, start - 2 * (i + 1), (reach - start + 2 * (i + 1)).cast("int")))
    all_ = _whole(F.concat(right, left))
    all_ = all_ if first else F.slice(all_, F.lit(2), F.greatest(F.size(all_), F.lit(1)))
    return F.when(size >= k, all_).otherwise(F.array().cast("array<string>"))


def onward_after(seq: Column, pos: Column, kind: Column, k: int, longest: int = LONGEST, before: int = 0) -> Column:
    """onward() of the read as it was before an error of this kind at pos, from `before` bases further left."""
    return onward(undo_error(seq, kind, pos.cast("int")), F.greatest(pos - before, F.lit(0)), k, longest)


def rightward(seq: Column, start: Column, k: int, longest: int = LONGEST) -> Column:
    """Windows from start that grow by two on the right."""
    return _whole(F.transform(_steps(_rungs(F.length(seq) - start, k, longest)), lambda i: part_of(seq, start, (k + 2 * i).cast("int"))))


def one_way(seq: Column, pos: Column, instead: Column, left_too: bool, right_too: bool, k: int, longest: int = LONGEST) -> Column:
    """Windows of odd size around `instead` that grow all the way to the left first, then to the right."""
    left = part_of(seq, F.lit(0), pos.cast("int")) if left_too else F.lit("")
    right = part_of(seq, pos + 1, F.length(seq)) if right_too else F.lit("")
    a, m = F.length(left), F.length(instead)
    most = F.least(a + F.length(right), F.lit(longest) - m, F.length(seq) - m)

    def window(t: Column) -> Column:
        t = t + 1
        from_left = F.least(a, t)
        return F.concat(F.right(left, from_left), instead, F.left(right, (t - from_left).cast("int")))

    return F.filter(F.transform(_steps(most), window), lambda w: (F.length(w) >= k) & (F.length(w) % 2 == 1))


def decided(rows: DataFrame, ladder: str, table: DataFrame, keys: list[str], more: tuple[str, ...] = (), window: bool = False) -> DataFrame:
    """rows without their ladder, with class and the table's columns `more` of the first window that is not REPEAT.

    keys tell rows apart; with window, that window comes too. A ladder that is empty, or repetitive to its end, gives
    REPEAT and null in the others.
    """
    known = table.select(F.col("kmer").alias("window"), "class", *more)
    plain = [c for c in rows.columns if c != ladder]
    out = [*(["window"] if window else []), *more]
    first = rows.withColumnRenamed("window", "__own") if "window" in plain else rows
    plain = ["__own" if c == "window" else c for c in plain]
    met = first.withColumn("window", F.get(ladder, F.lit(0))).join(known, "window", "left")
    met = met.withColumn("class", F.when(F.col("window").isNull(), "REPEAT").otherwise(F.coalesce("class", F.lit("UNTRUSTED"))))
    done = met.where((F.col("class") != "REPEAT") | (F.size(ladder) <= 1))
    done = done.select(*plain, "class", *[F.when(F.col("class") != "REPEAT", F.col(c)).alias(c) for c in out])
    grown = met.where((F.col("class") == "REPEAT") & (F.size(ladder) > 1)).select(*plain, ladder)
    steps = grown.select(*keys, F.posexplode(F.slice(ladder, F.lit(2), F.size(ladder))).alias("__step", "window")).join(known, "window", "left")
    steps = steps.withColumn("class", F.coalesce("class", F.lit("UNTRUSTED"))).where("class <> 'REPEAT'")
    best = steps.groupBy(*keys).agg(F.min_by(F.struct("class", *out), "__step").alias("__best"))
    late = grown.select(*plain).join(best, keys, "left").select(*plain, F.coalesce("__best.class", F.lit("REPEAT")).alias("class"), *[F.col(f"__best.{c}").alias(c) for c in out])
    both = done.unionByName(late)
    return both.drop("__own") if window else both.withColumnRenamed("__own", "window")


def judged_starts(reads: DataFrame, table: DataFrame, k: int, ladder: Callable[[Column, Column], Column]) -> DataFrame:
    """read_id, size (of the read), start, class and n (the deciding window's size; null for REPEAT) of the k-mer at every start of the reads.

    ladder makes windows from seq and start, the k-mer first. Only repetitive k-mers are put together with their read
    again to grow; the others go through one join as k-mers, without the read.
    """
    sized = reads.select("read_id", "seq", F.length("seq").alias("size"))
    at = positions(sized, k, ["read_id", "size"]).join(table.select("kmer", "class"), "kmer", "left")
    at = at.select("read_id", "size", F.col("pos").alias("start"), F.coalesce("class", F.lit("UNTRUSTED")).alias("class"))
    grown = at.where("class = 'REPEAT'").select("read_id", "size", "start").join(reads.select("read_id", "seq"), "read_id")
    grown = grown.select("read_id", "size", "start", ladder(F.col("seq"), F.col("start")).alias("ladder"))
    late = decided(grown, "ladder", table, ["read_id", "start"], window=True)
    return at.where("class <> 'REPEAT'").withColumn("n", F.lit(k)).unionByName(late.select("read_id", "size", "start", "class", F.length("window").alias("n")))


#: Gives kmer and class of all k-mers of the sizes asked for; a k-mer without a row is UNTRUSTED.
Classes = Callable[[list[int]], DataFrame]


def grown_starts(reads: DataFrame, classes: Classes, k: int) -> DataFrame:
    """read_id, size, start, class and n as judged_starts with onward(), without a bound on the windows' sizes.

    Starts that are still repetitive go through another round, which tries twice as many sizes as the one before.
    """
    sized = reads.select("read_id", "seq", F.length("seq").alias("size"))
    at = positions(sized, k, ["read_id", "size"]).join(classes([k]).select("kmer", "class"), "kmer", "left")
    at = at.select("read_id", "size", F.col("pos").alias("start"), F.coalesce("class", F.lit("UNTRUSTED")).alias("class"))
    at = written(at, "first-windows")
    found = at.where("class <> 'REPEAT'").withColumn("n", F.lit(k))
    open_ = at.where("class = 'REPEAT'").drop("class")
    on_right = F.floor((F.col("size") - F.col("start") - k) / 2) + 1
    rungs = on_right + F.floor(F.col("start") / 2)
    first, batch = 1, 1
    while not open_.isEmpty():
        table = classes([k + 2 * i for i in range(first, first + batch)]).select(F.col("kmer").alias("window"), "class")
        step, n = F.col("step"), k + 2 * F.col("step")
        begin = F.col("start") - 2 * F.greatest(step - on_right + 1, F.lit(0))
        each = open_.join(reads.select("read_id", "seq"), "read_id").select("*", F.explode(F.array(*[F.lit(i) for i in range(first, first + batch)])).alias("step")).where(step < rungs)
        each = each.select("read_id", "start", "step", part_of(F.col("seq"), begin, n.cast("int")).alias("window")).where(~F.col("window").contains("_"))
        kinds = each.join(table, "window", "left").select("read_id", "start", "step", F.coalesce("class", F.lit("UNTRUSTED")).alias("class")).where("class <> 'REPEAT'")
        best = kinds.groupBy("read_id", "start").agg(F.min(F.struct("step", "class")).alias("best"))
        state = written(open_.join(best, ["read_id", "start"], "left"), "grown-windows")
        first, batch = first + batch, 2 * batch
        found = found.unionByName(state.where("best is not null").select("read_id", "size", "start", "best.class", (k + 2 * F.col("best.step")).alias("n")))
        ended = state.where(F.col("best").isNull() & (rungs <= first)).select("read_id", "size", "start", F.lit("REPEAT").alias("class"), F.lit(None).cast("int").alias("n"))
        found = found.unionByName(ended)
        open_ = state.where(F.col("best").isNull() & (rungs > first)).drop("best")
    return found
