"""Correction of reads by k-mer classes and error profiles, and its evaluation.

All ways of correcting judge every place of the reads as they were sequenced and mend all places at once, so each is a
fixed number of joins however long the reads are, or one that grows with the logarithm of a read's length; what several
joins need is written to the shared folder once. The tables `known` (kmer) and `table` (kmer, class) may be any size.
Defined cases: reads without bases, or shorter than k, get no corrections; a read_id must be unique among the reads;
empty tables give empty tables. Ties between errors go to the higher score, the earlier place, the smaller number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import ERROR_TYPES, error_number, middle_quality, part_of, possible_errors, undo_error
from strandwise.operators import flanks, ladders
from strandwise.operators.counting import positions
from strandwise.operators.profiles import ErrorProfile
from strandwise.session import written

#: Two windows judge a fix: one from the place, one from so many bases before it.
BEFORE = 5


def substitutions(reads: DataFrame, trusted: DataFrame, k: int) -> DataFrame:
    """read_id, orig_pos and type: bases whose k-mer is unknown to `trusted` (kmer) and that one other base alone mends.

    Each k-mer is judged by its own first base, so places do not wait for each other and one join does them all.
    Several bases that would mend it leave the place as it is.
    """
    at = positions(reads, k, ["read_id"])
    known = trusted.select("kmer").distinct()
    unknown = at.join(known, "kmer", "left_anti")
    kinds = F.array(*map(F.lit, ERROR_TYPES[2:6]))
    tried = unknown.select("read_id", "pos", "kmer", F.explode(kinds).alias("type")).where(F.substring("type", -1, 1) != F.substring("kmer", 1, 1))
    tried = tried.withColumn("kmer", undo_error(F.col("kmer"), F.col("type"), F.lit(0)))
    mended = tried.join(known, "kmer", "left_semi")
    return mended.groupBy("read_id", "pos").agg(F.count("*").alias("ways"), F.min("type").alias("type")).where("ways = 1").select("read_id", F.col("pos").cast("long").alias("orig_pos"), "type")


def _tail(start: Column, k: int) -> Column:
    """Array of the places that the k-mer at start speaks for: start, and for a read's last one all behind it. Needs size."""
    return F.sequence(start, F.when(start + k == F.col("size"), F.col("size") - 1).otherwise(start)).cast("array<bigint>")


def unknown_places(reads: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """read_id and orig_pos of places whose k-mer is not known: the one that starts there or, in a read's tail, its last."""
    sized = reads.select("read_id", "seq", F.length("seq").alias("size"))
    unknown = positions(sized, k, ["read_id", "size"]).join(known.select("kmer").distinct(), "kmer", "left_anti")
    return unknown.select("read_id", F.explode(_tail(F.col("pos"), k)).alias("orig_pos"))


def candidates(at: DataFrame, indels: bool = True) -> DataFrame:
    """at (with place and flank) with type: each error that the place may stem from."""
    each = at.withColumn("type", F.explode(possible_errors(F.col("flank"), F.col("place"))))
    return each if indels else each.where(F.col("type").startswith("SUB"))


def _mended(tried: DataFrame) -> DataFrame:
    """tried (candidates) with mended, the flank without the error, in place of flank."""
    return tried.withColumn("mended", undo_error(F.col("flank"), F.col("type"), F.col("place"))).drop("flank")


def _window(back: int, n: Column | int) -> Column:
    """n bases of mended from `back` bases before place; at a read's ends, its first or last n."""
    return part_of(F.col("mended"), F.greatest(F.least(F.col("place") - back, F.length("mended") - n), F.lit(0)), n)


def by_kmers(reads: DataFrame, known: DataFrame, k: int, indels: bool = True, before: int = BEFORE) -> DataFrame:
    """read_id, orig_pos and type by k-mers of fixed size: places whose k-mer is not known and that one error alone explains.

    Of the read without the error, two windows of size k must be known, one from the place and one from `before` bases
    further left: with windows of equal size an insertion, which shortens what follows, is no easier to explain than a
    substitution. Several errors that would do leave the place as it is.
    """
    at = flanks.flanked(unknown_places(reads, known, k), reads, k + before, k + 1)
    return explained(at, known.select("kmer").distinct(), k, ["read_id", "orig_pos"], indels, before)


def explained(at: DataFrame, names: DataFrame, k: int, keys: list[str], indels: bool = True, before: int = BEFORE) -> DataFrame:
    """keys and type of places (at: keys, place and flank) that one error alone explains: without it, both windows of size k are among names (kmer, each once)."""
    tried = _mended(candidates(at, indels)).where(F.length("mended") >= k)
    tried = tried.select(*keys, "type", _window(0, k).alias("kmer"), _window(before, k).alias("earlier"))
    whole = tried.join(names, "kmer", "left_semi").join(names.withColumnRenamed("kmer", "earlier"), "earlier", "left_semi")
    return single(whole, keys)


def single(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and type of those keys that have one type."""
    return found.groupBy(*keys).agg(F.count("*").alias("ways"), F.min("type").alias("type")).where("ways = 1").select(*keys, "type")


def distinct_reads(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_id and seq of one read for each sequence, that of least read_id; and read_id and first (the one that stands for it) of all reads."""
    spark = reads.sparkSession
    named = reads.where("seq is not null").select("read_id", "seq")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Short rows make much work later: as many files as tasks, so that few reads don't end up in one.
    once = written(named.groupBy("seq").agg(F.min("read_id").alias("read_id")).select("read_id", "seq").repartition(n, "read_id"), "distinct-reads")
    copies = named.join(once.withColumnRenamed("read_id", "first"), "seq").select("read_id", "first")
    return once, written(copies, "read-copies")


def by_growing_kmers(reads: DataFrame, classes: ladders.Classes, k: int, indels: bool = True, before: int = BEFORE, starts: DataFrame | None = None) -> DataFrame:
    """read_id, orig_pos and type as by_kmers, with windows that grow while they are repetitive or several errors would do, as far as the read goes.

    classes gives kmer and class of all k-mers of the sizes asked for. starts: ladders.grown_starts or suffixes.grown_starts of
    these reads; without them, reads of equal sequence are judged once, as nothing else decides.
    A place is looked at if the first window from it that is not REPEAT is UNTRUSTED; behind a place whose windows all
    are REPEAT, a read is left as it is. An error holds at a size if, of the read without it, two windows of that size, from
    the place and from `before` bases further left, are not UNTRUSTED. Sizes rise by two from that of the window that showed
    the place to be wrong; the first at which one error at most holds decides. Each round tries twice as many sizes as the one before, on
    places that are still open.
    """
    if starts is None:
        once, copies = distinct_reads(reads)
        found = by_growing_kmers(once, classes, k, indels, before, ladders.grown_starts(once, classes, k))
        return found.withColumnRenamed("read_id", "first").join(copies, "first").select("read_id", "orig_pos", "type")
    judged = written(starts, "judged-starts")
    judged = judged.select("read_id", "size", "class", F.col("n").cast("int").alias("n"), F.explode(_tail(F.col("start"), k)).alias("orig_pos"))
    stop = judged.where("class = 'REPEAT'").groupBy("read_id").agg(F.min("orig_pos").alias("stop"))
    wrong = judged.where("class = 'UNTRUSTED'").join(stop, "read_id", "left").where("stop is null or orig_pos < stop")
    open_ = written(wrong.select("read_id", "orig_pos", "n", "size"), "growing-open")
    keys = ["read_id", "orig_pos"]
    found = open_.where(F.lit(False)).select(*keys, F.lit("").alias("type"))
    first, batch = 0, 1
    while sizes := [r.n for r in open_.select("n").distinct().collect()]:
        steps = F.explode(F.array(*[F.lit(j) for j in range(first, first + batch)])).alias("step")
        m = F.col("n") + 2 * F.col("step")
        wanted = sorted({n + 2 * j for n in sizes for j in range(first, first + batch)})
        known = written(classes(wanted).where("class <> 'UNTRUSTED'").select("kmer").distinct(), "growing-known")
        tried = _mended(candidates(flanks.flanked(open_.drop("size"), reads, wanted[-1] + before, wanted[-1] + 1), indels))
        tried = tried.select("*", steps).where((m <= F.col("size")) & (F.length("mended") >= m)).select(*keys, "step", "type", _window(0, m).alias("kmer"), _window(before, m).alias("earlier"))
        whole = tried.join(known, "kmer", "left_semi").join(known.withColumnRenamed("kmer", "earlier"), "earlier", "left_semi")
        ways = whole.groupBy(*keys, "step").agg(F.count("*").alias("ways"), F.min("type").alias("type"))
        grid = open_.select("*", steps).where(m <= F.col("size")).join(ways, [*keys, "step"], "left").withColumn("ways", F.coalesce("ways", F.lit(0)))
        hit = F.min(F.when(F.col("ways") <= 1, F.struct("step", "ways", "type"))).alias("hit")
        state = written(grid.groupBy(*keys, "n", "size").agg(hit), "growing-state")
        found = found.unionByName(state.where("hit.ways = 1").select(*keys, "hit.type"))
        first, batch = first + batch, 2 * batch
        open_ = state.where(F.col("hit").isNull() & (F.col("n") + 2 * first <= F.col("size"))).drop("hit")
    return found


def ranking(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores with rank (from 1) among rows of the same keys: higher scores first, then earlier places, then smaller numbers; null scores have no rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "orig_pos", error_number(F.col("type")))
    return scores.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order))


def by_ranked_kmers(reads: DataFrame, profile: ErrorProfile, table: DataFrame, k: int, longest: int = ladders.LONGEST, indels: bool = True) -> DataFrame:
    """read_id, orig_pos and type: reads are covered with k-mers, and of an untrusted one the likeliest error that makes it trusted is mended.

    The first k-mer starts at 0, each further one half a k-mer behind the last (behind its end without indels); it
    grows on the right while it is repetitive, and the last lies within the read. Errors of all places of a k-mer are
    ranked by the profile. A substitution or insertion is accepted if the k-mer without it (filled up behind an insertion
    by the next base) is trusted, grown on the right while it is repetitive. A deletion is accepted if the k-mers to both sides of the gap are not untrusted, the one
    across it without its base is, and with the base put in behind it it is trusted.
    """
    judged = written(ladders.judged_starts(reads, table, k, lambda seq, start: ladders.rightward(seq, start, k, longest)), "judged-starts")
    # One pass over a read's k-mers picks those that cover it: the next start depends on how far the last one grew.
    marks = judged.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("start", F.coalesce("n", F.lit(k)).alias("n")))).alias("marks"))
    step = (lambda n: F.greatest(F.floor(n / 2).cast("int"), F.lit(1))) if indels else (lambda n: n)
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))

    def visit(acc: Column, m: Column) -> Column:
        take = (m["start"] == acc["next"]) | ((m["start"] == F.size("marks") - 1) & (acc["next"] > m["start"]))
        return F.struct(F.when(take, m["start"] + step(m["n"])).otherwise(acc["next"]).alias("next"), F.when(take, F.concat(acc["out"], F.array(m["start"]))).otherwise(acc["out"]).alias("out"))

    visited = marks.select("read_id", F.explode(F.aggregate("marks", begin, visit, lambda acc: acc["out"])).alias("start"))
    wrong = judged.where("class = 'UNTRUSTED'").join(visited, ["read_id", "start"], "left_semi").select("read_id", "start", "n")
    wrong = wrong.join(reads.select("read_id", "seq"), "read_id").withColumn("window", part_of(F.col("seq"), F.col("start"), F.col("n"))).drop("n")
    at = wrong.select("read_id", "seq", "start", "window", F.explode(F.sequence("start", F.col("start") + F.length("window") - 1).cast("array<bigint>")).alias("orig_pos"))
    scored = profile.scores(at.select("read_id", "seq", "orig_pos").distinct())
    kinds = scored.where(~F.col("type").isin("CORRECT", "NODEL", "MULTIDEL"))
    ranked = written(ranking(at.join(kinds, ["read_id", "orig_pos"]), ["read_id", "start"]), "ranked-errors")
    accepted = _accepted(ranked, table, k, longest)
    best = accepted.groupBy("read_id", "start").agg(F.min_by(F.struct("orig_pos", "type"), "rank").alias("b"))
    return best.select("read_id", "b.orig_pos", "b.type").distinct()


def _accepted(ranked: DataFrame, table: DataFrame, k: int, longest: int) -> DataFrame:
    """Those rows of ranked (read_id, seq, start, window, orig_pos, type, rank) whose error makes its k-mer trusted."""
    keys = ["read_id", "start", "rank", "orig_pos", "type"]
    seq, pos = F.col("seq"), F.col("orig_pos").cast("int")
    plain = ranked.where(~F.col("type").startswith("DEL"))
    mended = F.concat(undo_error(F.col("window"), F.col("type"), pos - F.col("start")), part_of(seq, F.col("start") + F.length("window"), F.length("seq")))
    plain = plain.select(*keys, mended.alias("mended"), F.length("window").alias("size"))
    more = F.floor((F.least(F.length("mended"), F.lit(longest)) - F.col("size")) / 2).cast("int")
    plain = plain.select(*keys, F.transform(F.sequence(F.lit(0), F.greatest(more, F.lit(0))), lambda i: F.left("mended", (F.col("size") + 2 * i).cast("int"))).alias("ladder"))
    plain = ladders.decided(plain, "ladder", table, keys).where("class = 'TRUSTED'").select(*keys)
    gaps = ranked.where(F.col("type").startswith("DEL") & (F.col("orig_pos") < F.length("seq") - 1))
    base = part_of(seq, pos, 1)
    tests = {
        "left": (ladders.left_of(seq, pos + 1, k, longest), "class <> 'UNTRUSTED'"),
        "right": (ladders.right_of(seq, pos, k, longest), "class <> 'UNTRUSTED'"),
        "without": (ladders.middle(seq, pos, F.lit(""), k, longest), "class = 'UNTRUSTED'"),
        "with": (ladders.middle(seq, pos, F.concat(base, F.right("type", F.lit(1))), k, longest), "class = 'TRUSTED'"),
    }
    each = gaps.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("test"), ladder.alias("ladder")) for name, (ladder, _) in tests.items()])))
    judged = ladders.decided(each, "ladder", table, [*keys, "test"])
    passed = judged.where(" or ".join(f"test = '{name}' and {rule}" for name, (_, rule) in tests.items()))
    whole = passed.groupBy(*keys).agg(F.count("*").alias("tests")).where(f"tests = {len(tests)}").select(*keys)
    return plain.unionByName(whole)


def most_likely_errors(scores: DataFrame) -> DataFrame:
    """read_id, orig_pos and type: the best score of each place, apart for its base and for the gap behind it; the smaller number wins ties.

    CORRECT and NODEL win with a score of their own or where a place has no better one; then there is no row.
    """
    number = error_number(F.col("type"))
    best = F.max_by("type", F.struct("score", -number))
    each = scores.where(F.col("score").isNotNull()).groupBy("read_id", "orig_pos", (number >= 6).alias("gap")).agg(best.alias("type"))
    return each.where(~F.col("type").isin("CORRECT", "NODEL")).drop("gap")


def naive(reads: DataFrame, profile: ErrorProfile, indels: bool = True) -> DataFrame:
    """read_id, orig_pos and type: what the profile holds most likely at each place; without indels, substitutions only.

    No deletion is seen behind a read's last base.
    """
    scores = profile.read_scores(reads)
    if not indels:
        scores = scores.where(F.col("type").startswith("SUB") | F.col("type").isin("CORRECT", "NODEL"))
    found = most_likely_errors(scores).join(reads.select("read_id", F.length("seq").alias("size")), "read_id")
    return found.where(~(F.col("type").startswith("DEL") | (F.col("type") == "MULTIDEL")) | (F.col("orig_pos") < F.col("size") - 1)).drop("size")


#: Ways of correcting, by the numbers that settings use for them.
#: Bases of a read that are mended together: each looks for its fixes among those of its stretch only.
STRETCH = 64
CORRECTION_TYPES = ("NAIVE", "KMER_BASED", "KMER_IMPROVED")


def corrector(kind: str, table: DataFrame, k: int, profile: ErrorProfile | None = None, longest: int = ladders.LONGEST, indels: bool = True, classes: ladders.Classes | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from reads to corrections; kind is one of CORRECTION_TYPES.

    table: kmer and class of all sizes from k to longest; classes gives those of any sizes, for KMER_IMPROVED.
    """
    if kind not in CORRECTION_TYPES:
        raise ValueError(f"no such way of correcting: {kind}")
    if kind == "KMER_IMPROVED":
        if classes is None:
            raise ValueError(f"{kind} needs classes of all sizes")
        return lambda reads: by_growing_kmers(reads, classes, k, indels)
    if profile is None:
        raise ValueError(f"{kind} needs an error profile")
    if kind == "NAIVE":
        return lambda reads: naive(reads, profile, indels)
    return lambda reads: by_ranked_kmers(reads, profile, table, k, longest, indels)


def apply(reads: DataFrame, corrections: DataFrame) -> DataFrame:
    """reads with corrected, corrected_qual (if they have qual) and original_positions after all corrections of theirs.

    SUB_FROM_X puts X, INSERTION takes the base away, DEL_OF_X puts X behind it and MULTIDEL an underscore. A base that is
    put in has the mean quality of its neighbours, at a read's end that of the left one, and the left one's place.
    Reads without corrections stay as they are; null sequences stay null.
    """
    one = F.struct(F.col("orig_pos").cast("int").alias("orig_pos"), "type")
    lists = corrections.groupBy("read_id").agg(F.sort_array(F.collect_list(one)).alias("fixes"))
    met = reads.join(lists, "read_id", "left")
    here = F.sequence(F.lit(0), F.length("seq") - 1)
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / STRETCH).cast("int"))

    def stretch(c: Column) -> Column:
        """One stretch of the read: its start, its bases and qualities (of one more place) and its fixes."""
        first = c * STRETCH
        own = F.filter("fixes", lambda f: (f["orig_pos"] >= first) & (f["orig_pos"] < first + STRETCH))
        quals = [part_of(F.col("qual"), first, STRETCH + 1).alias("qual")] if "qual" in reads.columns else []
        return F.struct(first.alias("first"), part_of(F.col("seq"), first, STRETCH).alias("seq"), own.alias("fixes"), *quals)

    tail = lambda acc: F.substring(acc, F.lit(2), F.length(acc))

    def each_place(start: Callable, substitute: Callable, more: Callable) -> Column:
        """What stands at each place of the read after the fixes of that place; start(stretch, place in it), more(stretch, fix)."""

        def fixed(x: Column, p: Column) -> Column:
            def step(acc: Column, f: Column) -> Column:
                return F.when(f["type"] == "INSERTION", tail(acc)).when(f["type"].startswith("SUB"), substitute(acc, f)).otherwise(F.concat(acc, more(x, f)))

            return F.aggregate(F.filter(x["fixes"], lambda f: f["orig_pos"] == x["first"] + p), start(x, p), step)

        places = lambda x: F.sequence(F.lit(0), F.length(x["seq"]) - 1)
        return F.flatten(F.transform(F.transform(starts, stretch), lambda x: F.transform(places(x), lambda p: fixed(x, p))))

    put = lambda x, f: F.when(f["type"] == "MULTIDEL", "_").otherwise(F.right(f["type"], F.lit(1)))
    bases = each_place(lambda x, p: part_of(x["seq"], p, 1), lambda acc, f: F.concat(F.right(f["type"], F.lit(1)), tail(acc)), put)
    plain = F.col("fixes").isNull() | (F.length("seq") == 0)
    out = met.withColumn("__bases", F.when(~plain, bases))
    out = out.withColumn("corrected", F.when(plain, F.col("seq")).otherwise(F.array_join("__bases", "")))
    if "qual" in reads.columns:
        char = lambda x, p: part_of(x["qual"], p, 1)
        mean = lambda x, p: F.when(p + 1 < F.length(x["qual"]), middle_quality(char(x, p), char(x, p + 1))).otherwise(char(x, p))
        quals = each_place(char, lambda acc, f: acc, lambda x, f: mean(x, f["orig_pos"] - x["first"]))
        out = out.withColumn("corrected_qual", F.when(plain, F.col("qual")).otherwise(F.array_join(quals, "")))
    places_ = F.flatten(F.transform("__bases", lambda b, p: F.array_repeat(p, F.length(b))))
    none = F.when(F.length("seq") > 0, here).otherwise(F.array().cast("array<int>"))
    return out.withColumn("original_positions", F.when(F.col("seq").isNotNull(), F.when(plain, none).otherwise(places_))).drop("fixes", "__bases")


def confusion(truth: DataFrame, predicted: DataFrame, reads: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """type, tp, fp, fn and tn of each error type that can be judged.

    A prediction is right if the truth holds the same read_id, orig_pos and type. Places that neither touches are true
    negatives, of deletions only where a base follows. MULTIDEL has no true negatives. At masked places (read_id,
    orig_pos), whose truth is not known as an aligner clipped them, there are neither false positives nor true negatives.
    """
    t = truth.select("read_id", "orig_pos", "type").distinct().withColumn("true", F.lit(1))
    p = predicted.select("read_id", "orig_pos", "type").distinct().withColumn("said", F.lit(1))
    met = t.join(p, ["read_id", "orig_pos", "type"], "full")
    hidden = F.lit(False)
    if masked is not None:
        met = met.join(masked.select("read_id", "orig_pos").distinct().withColumn("hidden", F.lit(True)), ["read_id", "orig_pos"], "left")
        hidden = F.coalesce("hidden", F.lit(False))
    counts = met.groupBy("type").agg(
        F.count(F.when(F.col("true").isNotNull() & F.col("said").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("true").isNull() & ~hidden, 1)).alias("fp"),
        F.count(F.when(F.col("said").isNull(), 1)).alias("fn"),
    )
    touched = met.select("read_id", "orig_pos")
    if masked is not None:
        touched = touched.unionByName(masked.select("read_id", "orig_pos"))
    touched = touched.distinct().join(reads.select("read_id", F.length("seq").alias("size")), "read_id")
    taken = touched.where("orig_pos between 0 and size - 1").agg(F.count("*").alias("taken"), F.count(F.when(F.col("orig_pos") < F.col("size") - 1, 1)).alias("taken_inner"))
    every = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.greatest(F.length("seq") - 1, F.lit(0))), F.lit(0)).alias("inner"))
    kinds = truth.sparkSession.createDataFrame([(t,) for t in ERROR_TYPES[1:11]], "type string")
    each = kinds.join(counts, "type", "left").join(F.broadcast(every.crossJoin(taken)))
    free = F.when(F.col("type") == "MULTIDEL", 0).when(F.col("type").startswith("DEL"), F.col("inner") - F.col("taken_inner")).otherwise(F.col("bases") - F.col("taken"))
    return each.select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], free.cast("long").alias("tn"))


def metrics(table: DataFrame) -> DataFrame:
    """category, gain, sensitivity, specificity and f1 of deletions, insertions, substitutions and all; null where undefined."""
    kind = F.when(F.col("type") == "INSERTION", "insertions").when(F.col("type").startswith("SUB"), "substitutions").otherwise("deletions")
    each = table.select(F.explode(F.array(kind, F.lit("total"))).alias("category"), "tp", "fp", "fn", "tn")
    s = each.groupBy("category").agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")])
    share = lambda a, b: F.when(b != 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select("category", share(tp - fp, tp + fn).alias("gain"), share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
