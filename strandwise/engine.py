"""The whole work on one dataset: from reads, genome and alignments to corrected reads and how good they are.

Every step keeps its result in the dataset's folder and is read from there the next time. Steps can be called alone;
each calls those it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.sequence import minimum_k, reverse_complement
from strandwise.operators import classify, correction, counting, features, learning, profiles, truth
from strandwise.sources import alignment_files, sequence_files, stores

#: What errors are looked up in, by the numbers that settings use for them.
PROFILE_TYPES = ("OVERALL_STATS_ONLY", "MOTIF_STATS_ONLY", "MACHINE_LEARNING")
GENOME_TYPES = ("LINEAR", "CIRCULAR")


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's tables come from, and where results go. Functions give the tables, so any source will do."""

    name: str
    folder: str
    reads: Callable[[SparkSession], DataFrame]
    genome: Callable[[SparkSession], DataFrame] | None = None
    alignments: Callable[[SparkSession], DataFrame] | None = None
    genome_type: str = "CIRCULAR"
    quality: bool = True

    @classmethod
    def of_files(cls, name: str, folder: str, reads: str, genome: str | None = None, alignments: str | None = None, **more) -> Dataset:
        """From FASTQ reads, a FASTA genome and SAM or BAM alignments."""
        aligned = None
        if alignments:
            read = alignment_files.read_bam if alignments.endswith(".bam") else sequence_files.read_sam
            aligned = lambda spark: read(spark, alignments)
        return cls(name, folder, lambda spark: sequence_files.read_fastq(spark, reads, gaps=True), (lambda spark: sequence_files.read_fasta(spark, genome)) if genome else None, aligned, **more)


class Registry:
    """Datasets by name."""

    def __init__(self) -> None:
        self.known: dict[str, Dataset] = {}

    def add(self, dataset: Dataset) -> None:
        self.known[dataset.name] = dataset

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.known:
            raise KeyError(f"no such dataset: {name}")
        return self.known[name]


@dataclass
class Settings:
    """How each step is done; k and the longest k-mer are worked out from the genome unless given."""

    bias: str = "READS_ONLY"
    classification: str = "CHEATING"
    profile: str = "OVERALL_STATS_ONLY"
    correction: str = "KMER_IMPROVED"
    indels: bool = True
    accept: float = 1.0
    errors_only: bool = True
    k: int | None = None
    longest: int | None = None
    seed: int = 1
    observers: list[Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, dataset: Dataset, settings: Settings | None = None):
        self.spark, self.dataset, self.settings = spark, dataset, settings or Settings()
        if dataset.genome_type not in GENOME_TYPES:
            raise ValueError(f"no such genome type: {dataset.genome_type}")
        if self.settings.profile not in PROFILE_TYPES:
            raise ValueError(f"no such profile type: {self.settings.profile}")

    def _kept(self, name: str, make: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        return stores.stored(self.spark, f"{self.dataset.folder}/{name}", make, partition)

    @cached_property
    def reads(self) -> DataFrame:
        return self.dataset.reads(self.spark)

    @cached_property
    def genome(self) -> DataFrame:
        if self.dataset.genome is None:
            raise ValueError(f"{self.dataset.name} has no genome")
        return self.dataset.genome(self.spark)

    @cached_property
    def alignments(self) -> DataFrame:
        if self.dataset.alignments is None:
            raise ValueError(f"{self.dataset.name} has no alignments")
        return self.dataset.alignments(self.spark)

    @cached_property
    def genome_size(self) -> int:
        return self.genome.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first().n

    @cached_property
    def k(self) -> int:
        return self.settings.k or minimum_k(self.genome_size)

    @cached_property
    def sizes(self) -> list[int]:
        return list(range(self.k, (self.settings.longest or self.k + 10) + 1, 2))

    @cached_property
    def read_counts(self) -> DataFrame:
        return stores.kmer_counts(self.spark, f"{self.dataset.folder}/read_kmers", self.reads, self.sizes).drop("k")

    @cached_property
    def genome_counts(self) -> DataFrame:
        return stores.kmer_counts(self.spark, f"{self.dataset.folder}/genome_kmers", self.genome, self.sizes).drop("k")

    @cached_property
    def expected(self) -> DataFrame:
        lengths = counting.read_lengths(self.reads)
        return self._kept("expected", lambda: counting.expected_counts(lengths, self.genome_size, self.sizes, self.dataset.genome_type == "CIRCULAR"))

    def coverage_bias(self, kind: str | None = None) -> DataFrame:
        """gc_bin and bias, learned in one way or another."""
        kind = kind or self.settings.bias

        def learn() -> DataFrame:
            row = self.expected.where(F.col("k") == self.k).first()
            spans = None
            if kind == "ALIGNMENT":
                spans = truth.usable(self.alignments).select("contig", F.col("begin_pos").alias("first"), (F.col("begin_pos") + F.col("span") - 1).alias("last"))
            genome = self.genome if kind in ("ALIGNMENT", "REFERENCE") else None
            return counting.learned_bias(kind, self.k, row.e if row else 1.0, self.reads, genome, spans)

        return self._kept(f"bias_{kind.lower()}", learn)

    @cached_property
    def kmer_model(self):  # noqa: ANN201
        """The best model of k-mer classes, learned once."""
        path = f"{self.dataset.folder}/kmer_model"
        if not stores.exists(self.spark, path):
            _, model, _ = learning.train_kmer_model(self.reads, self.genome, self.k, self.coverage_bias(), self.expected, self.settings.seed)
            learning.save_model(model, path)
        return learning.load_model(path)

    @cached_property
    def classes(self) -> DataFrame:
        """kmer, class and z of every k-mer of reads and genome, of all sizes."""
        return self._kept(f"classes_{self.settings.classification.lower()}", lambda: self._classified(self.read_counts, self.genome_counts, self.expected))

    def _classified(self, reads: DataFrame, genome: DataFrame, expected: DataFrame) -> DataFrame:
        """kmer, class and z by counts of reads and genome and the expected counts of the same sizes."""
        kind = self.settings.classification
        every = reads.select("kmer").unionByName(genome.select("kmer")).distinct()
        model = self.kmer_model if kind == "MACHINE_LEARNING" else None
        return classify.classified(kind, every, reads, self.coverage_bias(), expected, self.k, genome if kind == "CHEATING" else None, model).select("kmer", "class", "z")

    def classes_of(self, sizes: list[int]) -> DataFrame:
        """kmer and class of every k-mer of these sizes: the kept ones, and others made as they are asked for."""
        out = self.classes.where(F.length("kmer").isin([n for n in sizes if n in self.sizes])).select("kmer", "class")
        more = [n for n in sizes if n not in self.sizes]
        if more:
            reads, genome = (classify.counts_of(seqs, more) for seqs in (self.reads, self.genome))
            expected = counting.expected_counts(counting.read_lengths(self.reads), self.genome_size, more, self.dataset.genome_type == "CIRCULAR")
            out = out.unionByName(self._classified(reads, genome, expected).select("kmer", "class"))
        return out

    @cached_property
    def true_corrections(self) -> DataFrame:
        """read_id, orig_pos and type of the errors that the alignments show."""
        return self._kept("true_corrections", lambda: truth.true_corrections(self.alignments, self.genome).select("read_id", "orig_pos", "type"))

    @cached_property
    def sequenced(self) -> DataFrame:
        """read_id and seq of the reads that true corrections are about."""
        back = F.col("flag").bitwiseAND(16) != 0
        return self._kept("aligned_reads", lambda: truth.usable(self.alignments).select("read_id", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq")))

    def write_true_reads(self, path: str) -> None:
        sequence_files.write_true_reads(truth.true_reads(self.alignments, self.genome), path)

    @cached_property
    def motif_scores(self) -> DataFrame:
        def make() -> DataFrame:
            strands = classify.counts_of(self.sequenced, list(range(1, profiles.LONGEST_MOTIF)))
            return profiles.motif_scores(profiles.motif_counts(self.true_corrections, self.sequenced), strands)

        return self._kept("motif_profile/motifs", make)

    @cached_property
    def profile(self) -> profiles.ErrorProfile:
        """The error profile that the settings name."""
        kind, path = self.settings.profile, f"{self.dataset.folder}/overall_profile"
        if kind == "MOTIF_STATS_ONLY":
            return profiles.MotifProfile(self.motif_scores)
        if kind == "OVERALL_STATS_ONLY":
            if not stores.exists(self.spark, path):
                stores.save_profile(profiles.OverallProfile.learned(self.true_corrections, self.sequenced), path)
            return stores.load_profile(self.spark, path)
        models = {kind: f"{self.dataset.folder}/classifier_profile/{kind}" for kind in ("current_base", "next_gap")}
        if not all(stores.exists(self.spark, p) for p in models.values()):
            learned = features.ClassifierProfile.learned(self.sequenced, self.true_corrections, self.motif_scores, self.settings.accept, self.settings.errors_only, self.settings.seed)
            for kind, path in models.items():
                learning.save_model(learned.models[kind], path)
        loaded = {kind: learning.load_model(path) for kind, path in models.items()}
        return features.ClassifierProfile(loaded, self.motif_scores, False, self.settings.errors_only)

    @cached_property
    def corrections(self) -> DataFrame:
        """read_id, orig_pos and type that correction finds in the reads."""
        s = self.settings
        profile = None if s.correction == "KMER_IMPROVED" else self.profile
        return self._kept(f"corrections_{s.correction.lower()}", lambda: correction.corrector(s.correction, self.classes, self.k, profile, self.sizes[-1], s.indels, self.classes_of)(self.reads))

    def correct_reads(self, path: str | None = None) -> DataFrame:
        """The reads with their corrected bases; written as FASTQ if there is a path. Observers get reads and corrections, their results come from observed()."""
        out = correction.apply(self.reads, self.corrections)
        if path:
            qual = F.col("corrected_qual") if "corrected_qual" in out.columns else F.repeat(F.lit("I"), F.length("corrected"))
            name = F.regexp_replace(F.col("read_id").cast("string"), "^@", "")
            sequence_files.write_fastq(out.select(name.alias("read_id"), F.col("corrected").alias("seq"), qual.alias("qual")), path)
        return out

    def observed(self) -> list[DataFrame]:
        """What each observer makes of the reads and their corrections; the reads are corrected once for all."""
        return [o(self.reads, self.corrections) for o in self.settings.observers]

    def evaluate(self) -> DataFrame:
        """Gain, sensitivity, specificity and F1 against the true corrections."""
        table = correction.confusion(self.true_corrections, self.corrections, self.reads, truth.clipped_places(self.alignments))
        return correction.metrics(table)


def all_biases(engine: Engine) -> DataFrame:
    """series, x (GC content) and y (bias) of every way to learn a bias."""
    each = {kind.lower(): engine.coverage_bias(kind).withColumn("gc", F.col("gc_bin") / engine.k) for kind in ("READS_ONLY", "ALIGNMENT", "REFERENCE")}
    return stores.overlaid(each, "gc", "bias")


def all_kmer_models(engine: Engine) -> dict[str, float]:
    """Macro F1 of every model of k-mer classes."""
    return learning.train_kmer_model(engine.reads, engine.genome, engine.k, engine.coverage_bias(), engine.expected, engine.settings.seed)[2]


def all_profiles(engine: Engine) -> dict[str, profiles.ErrorProfile]:
    """The dataset's error profile of every type."""
    out = {}
    for kind in PROFILE_TYPES:
        settings = Settings(**{**engine.settings.__dict__, "profile": kind})
        out[kind] = Engine(engine.spark, engine.dataset, settings).profile
    return out
