"""Features of places in reads, and an error profile learned from them.

A place has a row of features for its base and one for the gap behind it. Labels are error numbers: 0 to 5 for the base,
6 to 11 for the gap. Defined cases: a place outside its read has no features; without `qual`, tables have no quality
feature; a k-mer score is 0 where every window is repetitive or too short; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import ERROR_TYPES, error_number, error_type, part_of
from strandwise.operators import ladders, learning
from strandwise.operators.profiles import ErrorProfile, strongest_wide

# Names of features in training rows, and the types whose motifs each table has.
HEAD = ("current base", "position in read", "read length")
QUALITY = "quality score"
CURRENT_BASE, NEXT_GAP = ERROR_TYPES[1:6], (ERROR_TYPES[10], *ERROR_TYPES[6:10])
SIDES = ("left", "middle", "right")
MIDDLES = ("", "A", "C", "G", "T")


def feature_names(kind: str, quality: bool = True, kmer_z: bool = False) -> list[str]:
    """The columns of a table of features; kind: current_base or next_gap."""
    types = {"current_base": CURRENT_BASE, "next_gap": NEXT_GAP}[kind]
    zs = [f"k-merZ {side} '{m or '_'}'" for m in MIDDLES for side in SIDES] if kmer_z else []
    return [*HEAD, *([QUALITY] if quality else []), *zs, *[f"{t} motifZ" for t in types]]


def classes(kind: str, errors_only: bool = True) -> list[str]:
    """The types a model of this kind tells apart."""
    types = ERROR_TYPES[0:6] if kind == "current_base" else ERROR_TYPES[6:12]
    return [t for t in types if not (errors_only and t in ("CORRECT", "NODEL"))]


def kmer_scores(at: DataFrame, kind: str, table: DataFrame, empty_z: dict[int, float], k: int, longest: int = ladders.LONGEST) -> DataFrame:
    """read_id, orig_pos and a column for each side and each string put in the base's place (next_gap: behind the base).

    table: kmer, class and z of all sizes; empty_z: the score of a k-mer that no read holds, by size.
    """
    seq, pos = F.col("seq"), F.col("orig_pos").cast("int")
    base = part_of(seq, pos, 1) if kind == "next_gap" else F.lit("")
    rungs = [
        F.struct(F.lit(f"k-merZ {side} '{m or '_'}'").alias("name"), ladders.one_way(seq, pos, F.concat(base, F.lit(m)), side != "right", side != "left", k, longest).alias("ladder"))
        for m in MIDDLES
        for side in SIDES
    ]
    each = at.select("read_id", "orig_pos", F.inline(F.array(*rungs)))
    met = ladders.decided(each, "ladder", table, ["read_id", "orig_pos", "name"], more=("z",), window=True)
    unseen = F.element_at(F.create_map(*[F.lit(x) for pair in empty_z.items() for x in pair]), F.length("window"))
    z = F.when(F.col("class") == "REPEAT", 0.0).otherwise(F.coalesce("z", unseen))
    names = [n for n in feature_names(kind, False, True) if n.startswith("k-merZ")]
    return met.withColumn("z", z).groupBy("read_id", "orig_pos").agg(*[F.max(F.when(F.col("name") == n, F.col("z"))).alias(n) for n in names])


def features(at: DataFrame, kind: str, motif_z: DataFrame, kmer_z: DataFrame | None = None) -> DataFrame:
    """read_id, orig_pos and feature_names() of places (read_id, seq, orig_pos, and qual if its score is wanted).

    kmer_z: of kmer_scores(), if these are wanted.
    """
    types = CURRENT_BASE if kind == "current_base" else NEXT_GAP
    at = at.where((F.col("orig_pos") >= 0) & (F.col("orig_pos") < F.length("seq")))
    char = lambda c: F.ascii(part_of(F.col(c), F.col("orig_pos"), 1)).cast("double")
    own: list[Column] = [char("seq").alias(HEAD[0]), F.col("orig_pos").cast("double").alias(HEAD[1]), F.length("seq").cast("double").alias(HEAD[2])]
    if "qual" in at.columns:
        own.append(char("qual").alias(QUALITY))
    z = strongest_wide(at, motif_z, types)
    out = at.select("read_id", "orig_pos", *own).join(z.select("read_id", "orig_pos", *[F.col(t).alias(f"{t} motifZ") for t in types]), ["read_id", "orig_pos"], "left")
    out = out.na.fill(0.0, [f"{t} motifZ" for t in types])
    if kmer_z is not None:
        out = out.join(kmer_z, ["read_id", "orig_pos"])
    return out.select("read_id", "orig_pos", *feature_names(kind, "qual" in at.columns, kmer_z is not None))


def training_text(rows: DataFrame, names: list[str]) -> Column:
    """A row as text: features, then the label's number, with semicolons between."""
    return F.concat_ws(";", *[F.col(f"`{n}`").cast("string") for n in names], F.col("label").cast("string"))


def observed(reads: DataFrame, corrections: DataFrame, accept: float = 1.0, errors_only: bool = True, rate: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Places to learn bases and gaps from: read_id, seq (qual), orig_pos and label.

    Errors are accepted with a chance; unless errors_only, untouched places are drawn at the rate times that chance.
    """
    columns = [c for c in ("read_id", "seq", "qual") if c in reads.columns]
    number = error_number(F.col("type"))
    errors = learning.drawn(corrections.select("read_id", "orig_pos", number.alias("label")), accept, seed, "read_id", "orig_pos", "label")
    out = []
    for low, high, none in ((0, 5, 0), (6, 11, 11)):
        own = errors.where(F.col("label").between(low, high))
        rows = own.join(reads.select(*columns), "read_id")
        if not errors_only:
            every = reads.where(F.length("seq") > 0).select(*columns, F.explode(F.sequence(F.lit(0), F.length("seq") - 1).cast("array<bigint>")).alias("orig_pos"))
            free = learning.drawn(every, rate * accept, seed + 1 + low, "read_id", "orig_pos").join(own.select("read_id", "orig_pos"), ["read_id", "orig_pos"], "left_anti")
            rows = rows.unionByName(free.withColumn("label", F.lit(none)))
        out.append(rows.select(*columns, "orig_pos", "label"))
    return out[0], out[1]


class ClassifierProfile(ErrorProfile):
    """Two models, one of bases and one of gaps; scores are their probabilities. Types that a model never saw score 0.

    Places must have qual if the models were trained with it.
    """

    score_kind = "probability"

    def __init__(self, models: dict[str, object], motif_z: DataFrame, quality: bool, errors_only: bool = True):
        self.models, self.motif_z, self.quality, self.errors_only = models, motif_z, quality, errors_only

    @classmethod
    def learned(cls, reads: DataFrame, corrections: DataFrame, motif_z: DataFrame, accept: float = 1.0, errors_only: bool = True, seed: int = 1) -> ClassifierProfile:
        models = {}
        for kind, rows in zip(("current_base", "next_gap"), observed(reads, corrections, accept, errors_only, seed=seed)):
            keyed = rows.select("read_id", "orig_pos", "label")
            names = feature_names(kind, "qual" in reads.columns)
            table = features(rows.drop("label").distinct(), kind, motif_z).join(keyed, ["read_id", "orig_pos"])
            plain = plain_names(table, names)
            models[kind] = learning.best_model(plain, plain_list(names), seed, "read_id", "orig_pos")[1]
        return cls(models, motif_z, "qual" in reads.columns, errors_only)

    def scores(self, at: DataFrame) -> DataFrame:
        if self.quality and "qual" not in at.columns:
            raise ValueError("the models were trained with quality scores, which these places lack")
        at = at if self.quality else at.select("read_id", "seq", "orig_pos")
        out = None
        for kind, model in self.models.items():
            rows = plain_names(features(at, kind, self.motif_z), feature_names(kind, self.quality))
            labels = [ERROR_TYPES.index(t) for t in classes(kind, self.errors_only)]
            each = learning.probabilities(model, rows, labels, ["read_id", "orig_pos"])
            each = each.select("read_id", "orig_pos", error_type(F.col("label")).alias("type"), F.col("p").alias("score"))
            out = each if out is None else out.unionByName(each)
        return out

    def read_scores(self, reads: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
        end = F.length("seq") - 1 if last is None else F.least(F.length("seq") - 1, F.lit(last))
        columns = [c for c in ("read_id", "seq", "qual") if c in reads.columns]
        return self.scores(reads.where(F.length("seq") > first).select(*columns, F.explode(F.sequence(F.lit(first), end).cast("array<bigint>")).alias("orig_pos")))


def plain_list(names: list[str]) -> list[str]:
    return [f"f{i}" for i in range(len(names))]


def plain_names(rows: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns under names that models can take."""
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, *[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain_list(names))])
