"""Error profiles: overall counts, and motifs around errors, and what they say of a place in a read.

A profile gives rows read_id, orig_pos, type and score for places (read_id, seq, orig_pos). Scores of different
profiles can't be compared, so score_kind goes with them; within one profile a higher score makes a type likelier.
Defined cases: places outside their read, and reads without bases, have no scores; empty tables give empty tables.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import ERROR_TYPES, part_of
from strandwise.operators import flanks

LONGEST_MOTIF = 6


def overall(corrections: DataFrame, reads: DataFrame) -> DataFrame:
    """type, n, rate and log_p of each of the twelve types; a type that never occurs has a null log_p."""
    total = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    counts = corrections.groupBy("type").agg(F.count("*").alias("n"))
    sums = corrections.agg(
        F.count(F.when(F.col("type").startswith("SUB") | (F.col("type") == "INSERTION"), 1)).alias("wrong"),
        F.count(F.when(F.col("type").startswith("DEL") | (F.col("type") == "MULTIDEL"), 1)).alias("deleted"),
    )
    kinds = corrections.sparkSession.createDataFrame([(t,) for t in ERROR_TYPES], "type string")
    each = kinds.join(counts, "type", "left").join(F.broadcast(total.crossJoin(sums)))
    n = F.when(F.col("type") == "CORRECT", F.col("bases") - F.col("wrong")).when(F.col("type") == "NODEL", F.col("bases") - F.col("deleted")).otherwise(F.coalesce("n", F.lit(0)))
    each = each.select("type", n.alias("n"), "bases")
    return each.select("type", "n", F.when(F.col("bases") > 0, F.col("n") / F.col("bases")).alias("rate"), F.when((F.col("n") > 0) & (F.col("bases") > 0), F.ln(F.col("n") / F.col("bases"))).alias("log_p"))


def substitution_matrix(corrections: DataFrame, reads: DataFrame) -> DataFrame:
    """true_base, read_base and n of the substitutions."""
    subs = corrections.where(F.col("type").startswith("SUB_FROM_")).join(reads.select("read_id", "seq"), "read_id")
    return subs.groupBy(F.substring("type", -1, 1).alias("true_base"), part_of(F.col("seq"), F.col("orig_pos"), 1).alias("read_base")).agg(F.count("*").alias("n"))


def windows(at: DataFrame, shortest: int = 1, longest: int = LONGEST_MOTIF) -> DataFrame:
    """at with motif and pos (the place in the motif) for each window of the read over orig_pos."""
    first = F.greatest(F.col("orig_pos") - (longest - 1), F.lit(0))
    # Windows are cut out of what lies around the place, which is cut out of the read once.
    near = at.withColumn("__near", part_of(F.col("seq"), first, 2 * longest)).withColumn("__place", F.col("orig_pos") - first).withColumn("__bases", F.length("seq"))
    each = near.withColumn("size", F.explode(F.sequence(F.lit(shortest), F.lit(longest)))).withColumn("pos", F.expr("explode(sequence(0, size - 1))"))
    whole = each.where((F.col("orig_pos") >= F.col("pos")) & (F.col("orig_pos") - F.col("pos") + F.col("size") <= F.col("__bases")))
    return whole.withColumn("motif", part_of(F.col("__near"), F.col("__place") - F.col("pos"), F.col("size"))).drop("size", "__near", "__place", "__bases")


def motif_counts(corrections: DataFrame, reads: DataFrame, longest: int = LONGEST_MOTIF) -> DataFrame:
    """motif, pos, type and n: errors by each window of up to `longest` read bases around them."""
    at = corrections.select("read_id", "orig_pos", "type").join(reads.select("read_id", "seq"), "read_id")
    return windows(at, 1, longest).groupBy("motif", "pos", "type").agg(F.count("*").alias("n"))


def motif_scores(counts: DataFrame, strands: DataFrame, longest: int = LONGEST_MOTIF) -> DataFrame:
    """motif, pos, type and z of every motif of three bases and more for which errors can be expected, seen or not.

    Expected: left part times right part over the inner part. A part that does not hold pos counts how often reads
    (both strands: `strands` has kmer and n) hold it. All motifs whose left and right part have a count are made by
    joining these on the inner part; motifs without a row have a count of 0 in one of them, and score 0.
    """
    size = F.length("m")
    held = counts.select(F.col("motif").alias("m"), "pos", "type", F.col("n").cast("double").alias("n")).where(size.between(2, longest - 1))
    free = strands.select(F.col("kmer").alias("m"), F.col("n").cast("double").alias("n")).where(size.between(2, longest - 1))
    inner_held = counts.select(F.col("motif").alias("inner"), (F.col("pos") + 1).alias("pos"), "type", F.col("n").cast("double").alias("i"))
    inner_free = strands.select(F.col("kmer").alias("inner"), F.col("n").cast("double").alias("i"))
    left = lambda t, *more: t.select(F.expr("substring(m, 2)").alias("inner"), F.expr("left(m, 1)").alias("head"), F.col("n").alias("l"), *more)
    right = lambda t, *more: t.select(F.expr("left(m, length(m) - 1)").alias("inner"), F.expr("right(m, 1)").alias("tail"), F.col("n").alias("r"), *more)
    kind = [F.col("type")]
    # The place is the motif's first, its last, or one between.
    ends = [
        (left(held.where("pos = 0"), *kind, F.lit(0).alias("pos")), right(free), ["inner"], inner_free),
        (left(free), right(held.where("pos = length(m) - 1"), *kind, (F.col("pos") + 1).alias("pos")), ["inner"], inner_free),
        (left(held.where("pos > 0"), *kind, "pos"), right(held.where("pos < length(m) - 1"), *kind, (F.col("pos") + 1).alias("pos")), ["inner", "type", "pos"], inner_held),
    ]
    made = []
    for a, b, on, inner in ends:
        both = a.join(b, on)
        made.append(both.join(inner, on, "left").select(F.concat("head", "inner", "tail").alias("motif"), F.col("pos").cast("int").alias("pos"), "type", "l", "r", F.coalesce("i", F.lit(0.0)).alias("i")))
    domain = made[0].unionByName(made[1]).unionByName(made[2])
    each = domain.join(counts.select("motif", "pos", "type", F.col("n").alias("obs")), ["motif", "pos", "type"], "left")
    var = F.expr("(l * r / i) * (i - l) * (i - r) / (i * i)")
    z = F.when((F.col("i") != 0) & (var > 0), (F.coalesce("obs", F.lit(0)) - F.expr("l * r / i")) / F.sqrt(var)).otherwise(0.0)
    return each.select("motif", "pos", "type", z.alias("z"))


#: Types that motifs score: all but CORRECT and NODEL.
SCORED = ERROR_TYPES[1:11]


def strongest_wide(at: DataFrame, scores: DataFrame, types: tuple[str, ...] = SCORED) -> DataFrame:
    """read_id, orig_pos and a column for each of the types: of all windows over a place, the score farthest from 0; of equal ones, the higher.

    Scores of one motif and place go side by side first, so that a place's windows are joined once, not once a type.
    """
    wide = scores.where(F.col("type").isin(*types)).groupBy("motif", "pos").agg(*[F.max(F.when(F.col("type") == t, F.col("z"))).alias(t) for t in types])
    each = windows(at.select("read_id", "orig_pos", "seq"), 3).join(wide, ["motif", "pos"], "left")

    def end(t: str):  # noqa: ANN202
        low, high = F.min(F.coalesce(t, F.lit(0.0))), F.max(F.coalesce(t, F.lit(0.0)))
        return F.when(F.abs(low) > F.abs(high), low).otherwise(high).alias(t)

    return each.groupBy("read_id", "orig_pos").agg(*[end(t) for t in types])


def long_form(wide: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """A row for each place and type: read_id, orig_pos, type and score."""
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("score")) for t in types])
    return wide.select("read_id", "orig_pos", F.inline(pairs))


def strongest(at: DataFrame, scores: DataFrame) -> DataFrame:
    """read_id, orig_pos, type and z of places whose type is known."""
    wide = strongest_wide(at.select("read_id", "orig_pos", "seq").distinct(), scores)
    return at.select("read_id", "orig_pos", "type").join(long_form(wide, SCORED), ["read_id", "orig_pos", "type"]).withColumnRenamed("score", "z")


def places(reads: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """read_id, seq and orig_pos of every place of reads, or of those from first to last."""
    size = F.length("seq")
    end = size - 1 if last is None else F.least(size - 1, F.lit(last))
    return reads.where(size > first).select("read_id", "seq", F.explode(F.sequence(F.lit(first), end).cast("array<bigint>")).alias("orig_pos"))


def kmer_places(kmers_: DataFrame, pos: int) -> DataFrame:
    """The same place of each k-mer, which serves as its own read_id."""
    return kmers_.select(F.col("kmer").alias("read_id"), F.col("kmer").alias("seq"), F.lit(pos).cast("long").alias("orig_pos"))


class ErrorProfile(ABC):
    """What errors a place of a read may hold. New profiles extend this class."""

    score_kind = "score"
    #: How many bases on each side of a place its scores depend on; None: the whole read.
    reach: int | None = None

    @abstractmethod
    def scores(self, at: DataFrame) -> DataFrame:
        """read_id, orig_pos, type and score of places (read_id, seq, orig_pos)."""

    def read_scores(self, reads: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
        """The scores of every place of reads, or of those from first to last; with a reach, piece by piece of long reads."""
        if self.reach is None:
            return self.scores(places(reads, first, last))
        cut = flanks.pieces(reads, self.reach, self.reach)
        begin = F.greatest(F.col("piece") * flanks.SPAN, F.lit(first))
        end = F.least(F.col("piece") * flanks.SPAN + flanks.SPAN, F.col("size"), *([] if last is None else [F.lit(last + 1)])) - 1
        cut = cut.withColumn("from", begin - F.col("begin")).withColumn("to", end - F.col("begin")).where(F.col("from") <= F.col("to"))
        at = cut.select(F.struct("read_id", "begin").alias("read_id"), F.col("part").alias("seq"), F.explode(F.sequence("from", "to").cast("array<bigint>")).alias("orig_pos"))
        each = self.scores(at)
        return each.withColumn("orig_pos", F.col("orig_pos") + F.col("read_id.begin")).withColumn("read_id", F.col("read_id.read_id"))

    def kmer_scores(self, kmers_: DataFrame, pos: int) -> DataFrame:
        return self.scores(kmer_places(kmers_, pos)).withColumnRenamed("read_id", "kmer")


def _checked(at: DataFrame) -> DataFrame:
    """at with its read base; an underscore, where several bases are missing, has no scores and raises an error."""
    base = part_of(F.col("seq"), F.col("orig_pos"), 1)
    return at.withColumn("base", F.when(base == "_", F.raise_error(F.lit("no scores for a place without a base")).cast("string")).otherwise(base))


class OverallProfile(ErrorProfile):
    """Each type's rate over all bases, substitutions by read base; scores are logarithms of probabilities.

    A substitution from the base that was read is no error and has no row.
    """

    score_kind = "log probability"
    reach = 0

    def __init__(self, rates: DataFrame, matrix: DataFrame, bases: int):
        """rates: type and log_p as of overall(); matrix: as of substitution_matrix(); bases: of all reads."""
        self.rates, self.matrix, self.bases = rates, matrix, bases

    @classmethod
    def learned(cls, corrections: DataFrame, reads: DataFrame) -> OverallProfile:
        bases = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first().n
        return cls(overall(corrections, reads).select("type", "log_p"), substitution_matrix(corrections, reads), bases)

    def table(self) -> DataFrame:
        """base, type and log_p; types never seen have a null log_p."""
        spark = self.rates.sparkSession
        letters = spark.createDataFrame([(b,) for b in "ACGT"], "base string")
        plain = letters.crossJoin(F.broadcast(self.rates.where(~F.col("type").startswith("SUB"))))
        pairs = letters.crossJoin(F.broadcast(letters.withColumnRenamed("base", "true_base"))).where("base <> true_base")
        subs = pairs.join(F.broadcast(self.matrix), (F.col("read_base") == F.col("base")) & (pairs["true_base"] == self.matrix["true_base"]), "left")
        subs = subs.select("base", F.concat(F.lit("SUB_FROM_"), pairs["true_base"]).alias("type"), F.when(F.col("n") > 0, F.ln(F.col("n") / F.lit(float(max(1, self.bases))))).alias("log_p"))
        return plain.select("base", "type", "log_p").unionByName(subs)

    def scores(self, at: DataFrame) -> DataFrame:
        return _checked(at).join(F.broadcast(self.table()), "base").select("read_id", "orig_pos", "type", F.col("log_p").alias("score"))


class MotifProfile(ErrorProfile):
    """The strongest motif over a place for each type; CORRECT and NODEL score 0, a substitution from the base that was read has no row."""

    score_kind = "z-score"
    reach = LONGEST_MOTIF - 1

    def __init__(self, z: DataFrame):
        self.z = z

    @classmethod
    def learned(cls, corrections: DataFrame, reads: DataFrame, strands: DataFrame) -> MotifProfile:
        return cls(motif_scores(motif_counts(corrections, reads), strands))

    def scores(self, at: DataFrame) -> DataFrame:
        wide = strongest_wide(at, self.z).join(_checked(at).select("read_id", "orig_pos", "base"), ["read_id", "orig_pos"])
        wide = wide.withColumn("CORRECT", F.lit(0.0)).withColumn("NODEL", F.lit(0.0))
        pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("score")) for t in ERROR_TYPES])
        each = wide.select("read_id", "orig_pos", "base", F.inline(pairs))
        return each.where(F.col("type") != F.concat(F.lit("SUB_FROM_"), F.col("base"))).select("read_id", "orig_pos", "type", "score")


def error_rates(profile: DataFrame) -> DataFrame:
    """One row: the share of wrong bases, and of bases before missing ones, of overall()."""
    rate = lambda t: 1 - F.max(F.when(F.col("type") == t, F.col("rate")))
    return profile.agg(rate("CORRECT").alias("current_base"), rate("NODEL").alias("next_gap"))


def printed(scores: DataFrame) -> DataFrame:
    """The motifs that stand out, by at least one deviation."""
    return scores.where(F.abs("z") >= 1)
