"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import sequence as S
from strandwise.operators import classify, correction, counting, features, gaps, in_order, ladders, learning, profiles, suffixes, truth
from strandwise.plans import fixtures, oracle
from strandwise.session import written
from strandwise.sources import stores

K = 11
SIZES = list(range(K, ladders.LONGEST + 1, 2))
FLAGSHIP = "kmer_count_both_strands"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _genome_size(genome: DataFrame) -> int:
    return genome.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first().n


def _expected_rows(spark: SparkSession, sf_dir: str, ks: list[int]) -> DataFrame:
    return counting.expected_counts(counting.read_lengths(fixtures.simulated(spark, sf_dir)), _genome_size(fixtures.genome(spark, sf_dir)), ks)


def _expected(spark: SparkSession, sf_dir: str) -> float:
    """Expected count at K."""
    row = _expected_rows(spark, sf_dir, [K]).first()
    return row.e if row else 1.0


# Sequence functions.


@query
def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return fixtures.reads(spark, sf_dir).select("read_id", S.reverse_complement(s, strict=True).alias("rc"), F.round(S.gc_content(s), 9).alias("gc"), S.gc_bin(s).alias("gc_bin"), S.middle_quality(F.substring("qual", 1, 1), F.substring("qual", 2, 1)).alias("mid_quality"))


@query
def base_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient other strand, the base across, names, and motifs by number and back."""
    s = F.col("seq")
    odd = F.concat(F.substring(s, 1, 5), F.lit("_N"))
    name = F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit("/1 x/2"))
    index = S.motif_index(F.substring(s, 1, 6))
    return fixtures.simulated(spark, sf_dir).select(
        "read_id", S.reverse_complement(odd).alias("rc"), S.base_complement(F.substring(odd, 5, 1)).alias("base"), S.base_complement(F.substring(odd, 6, 1)).alias("gap"),
        S.read_name(name).alias("name"), index.alias("motif_index"), S.motif_at(index).alias("motif"), S.motif_index(F.substring(odd, 5, 3)).alias("odd_index"),
    )


@query
def minimum_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least k for genomes of each contig's length, and of all together."""
    lengths = [r.n for r in fixtures.genome(spark, sf_dir).select(F.length("seq").alias("n")).distinct().collect()]
    return spark.createDataFrame([(n, S.minimum_k(n)) for n in sorted(lengths)], "genome_size int, k int")


@query
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error types of all planted errors and classes of all genome k-mers, to numbers and back, with how often each occurs."""
    types = fixtures.planted(spark, sf_dir).select(F.lit("error").alias("of"), "type").groupBy("of", "type").agg(F.count("*").alias("n"))
    kinds = classify.by_genome(counting.count_both(fixtures.genome(spark, sf_dir), K), counting.count_forward(fixtures.genome(spark, sf_dir), K))
    kinds = kinds.groupBy(F.lit("kmer").alias("of"), F.col("class").alias("type")).agg(F.count("*").alias("n"))
    number = F.when(F.col("of") == "error", S.error_number(F.when(F.col("of") == "error", F.col("type")))).otherwise(S.kmer_type_number(F.when(F.col("of") == "kmer", F.col("type"))))
    out = types.unionByName(kinds).withColumn("number", number)
    error, kmer = (F.when(F.col("of") == of, F.col("number")) for of in ("error", "kmer"))
    return out.withColumn("name", F.coalesce(S.error_type(error), S.kmer_type(kmer)))


@query
def md_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.md_tags(spark, sf_dir).withColumn("found", S.md_substitutions(F.col("md")))
    return found.select("read_id", F.size("found").alias("n"), S.md_text(F.col("found")).alias("printed"))


@query
def correction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted errors as corrections, with the type inferred from the bases, as text."""
    at = fixtures.planted(spark, sf_dir).join(fixtures.simulated(spark, sf_dir).select("read_id", "seq"), "read_id")
    old = S.part_of(F.col("seq"), F.col("orig_pos"), 1)
    new = F.when(F.col("type") == "INSERTION", "").when(F.col("type").startswith("SUB"), F.right("type", F.lit(1))).otherwise(F.concat(old, F.right("type", F.lit(1))))
    c = S.correction(F.col("orig_pos"), F.col("orig_pos"), F.col("old"), F.col("new"))
    each = at.select("read_id", "orig_pos", old.alias("old"), new.alias("new")).withColumn("c", c)
    return each.select("read_id", "orig_pos", S.correction_text(F.col("c.type"), F.col("c.pos"), F.col("c.old"), F.col("c.new"), F.col("c.prob")).alias("line"))


@query
def error_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = counting.positions(fixtures.genome(spark, sf_dir), K, ["contig"])
    each = at.select("contig", "pos", "kmer", F.explode(S.possible_errors(F.col("kmer"), F.lit(0))).alias("type"))
    return each.select("contig", "pos", "type", S.error_number(F.col("type")).alias("number"), S.kmer_after_error(F.col("kmer"), F.col("type"), F.lit(0)).alias("before"))


# Counts, expected counts and bias.


@query
def kmer_count_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_both(fixtures.reads(spark, sf_dir), K)


@query
def kmer_count_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_forward(fixtures.genome(spark, sf_dir), K)


@query
def kmer_count_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several sizes, one of them too long to be packed, by size."""
    counts = classify.counts_of(fixtures.simulated(spark, sf_dir), [10, 31, 33])
    return counts.groupBy(F.length("kmer").alias("k"), "n").agg(F.count("*").alias("kmers"), F.min("kmer").alias("first"))


@query
def read_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.read_lengths(fixtures.reads(spark, sf_dir))


@query
def read_length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.read_lengths(fixtures.simulated(spark, sf_dir)).agg(F.min("length").alias("shortest"), F.max("length").alias("longest"), F.sum("n").alias("reads"))


@query
def expected_counts_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expected_rows(spark, sf_dir, [11, 13, 15]).select("k", F.round("e", 6).alias("e"), F.round("sd", 6).alias("sd"))


@query
def expected_counts_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, size = counting.read_lengths(fixtures.simulated(spark, sf_dir)), _genome_size(fixtures.genome(spark, sf_dir))
    return counting.expected_counts(lengths, size, [11, 13, 15], circular=False).select("k", F.round("e", 6).alias("e"), F.round("sd", 6).alias("sd"))


def _rounded(bias: DataFrame) -> DataFrame:
    return bias.select("gc_bin", F.round("bias", 6).alias("bias"), "n_ratios")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.usable(fixtures.alignments(spark, sf_dir)).select("contig", F.col("begin_pos").alias("first"), (F.col("begin_pos") + F.col("span") - 1).alias("last"))


@query
def bias_from_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    genome, reads = fixtures.genome(spark, sf_dir), fixtures.simulated(spark, sf_dir)
    return _rounded(counting.bias_from_reference(genome, counting.count_both(reads, K), K, _expected(spark, sf_dir)))


@query
def bias_from_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fixtures.simulated(spark, sf_dir)
    return _rounded(counting.bias_from_reads(counting.count_forward(reads, K), counting.count_both(reads, K), _expected(spark, sf_dir)))


@query
def bias_from_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(counting.bias_from_alignment(fixtures.genome(spark, sf_dir), _spans(spark, sf_dir), K, _expected(spark, sf_dir)))


def _bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.learned_bias("READS_ONLY", K, _expected(spark, sf_dir), reads=fixtures.simulated(spark, sf_dir))


@query
def bias_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads-only bias without empty bins, as numbers and as it is printed; and none at all."""
    reads = fixtures.simulated(spark, sf_dir)
    none = counting.learned_bias("IGNORE", K, 1.0, reads=reads).withColumn("kind", F.lit("IGNORE"))
    both = _bias(spark, sf_dir).withColumn("kind", F.lit("READS_ONLY")).unionByName(none)
    bias = F.round("bias", 6)
    return both.select("kind", "gc_bin", bias.alias("bias"), F.length(stores.bias_text(F.col("gc_bin"), F.round("bias").cast("int"), K)).alias("printed"))


@query
def bias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads-only bias at each distinct genome 13-mer, between the bins of 11-mers."""
    kmers = counting.count_forward(fixtures.genome(spark, sf_dir), 13).select("kmer")
    return counting.bias_of(kmers, _bias(spark, sf_dir), K).select("kmer", F.round("bias", 6).alias("bias"))


@query
def bias_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three biases as series over the GC content."""
    e, reads, genome = _expected(spark, sf_dir), fixtures.simulated(spark, sf_dir), fixtures.genome(spark, sf_dir)
    counts = counting.count_both(reads, K)
    learned = {
        "reads": counting.bias_from_reads(counting.count_forward(reads, K), counts, e),
        "reference": counting.bias_from_reference(genome, counts, K, e),
        "alignment": counting.bias_from_alignment(genome, _spans(spark, sf_dir), K, e),
    }
    return stores.overlaid({name: b.withColumn("gc", F.col("gc_bin") / K) for name, b in learned.items()}, "gc", "bias").select("series", F.round("x", 9).alias("x"), F.round("y", 6).alias("y"))


# Classes of k-mers.


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counting.count_both(fixtures.simulated(spark, sf_dir), K)
    return classify.with_features(counts.select("kmer"), counts, _bias(spark, sf_dir), _expected_rows(spark, sf_dir, [K]), K)


@query
def kmer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read k-mer, judged by its z-score, by its count and by the genome, with the bias learned from reads."""
    each = _features(spark, sf_dir)
    each = each.select("kmer", "n", F.round("z", 6).alias("z"), classify.statistical(F.col("z")).alias("statistical"), classify.naive(F.col("n"), F.col("bias"), F.col("e")).alias("naive"))
    return classify.by_genome(each, counting.count_both(fixtures.genome(spark, sf_dir), K))


@query
def kmer_rule_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.kmer_features(_features(spark, sf_dir))
    naive, statistical = (learning.RuleModel(m).transform(rows).select("kmer", F.col("prediction").cast("int").alias(m)) for m in ("naive", "statistical"))
    return naive.join(statistical, "kmer").groupBy("naive", "statistical").agg(F.count("*").alias("kmers"))


@query
def kmer_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to learn k-mer classes from: the bound of the sample is far above these tables."""
    rows = learning.training_rows(fixtures.simulated(spark, sf_dir), fixtures.genome(spark, sf_dir), K, _bias(spark, sf_dir), _expected_rows(spark, sf_dir, [K]))
    return rows.select("kmer", *[F.round(c, 5).alias(c) for c in learning.KMER_FEATURES], "label")


def _judged_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out training rows (those whose name has a digest that begins with 0 to 4) with scores by a Gaussian model of the others."""
    rows = written(kmer_training_rows(spark, sf_dir), "model-rows")
    held = F.left(F.md5("kmer"), F.lit(1)).isin(*"01234")
    return learning.GaussianModel.learned(rows.where(~held), list(learning.KMER_FEATURES)).transform(rows.where(held))


@query
def kmer_model_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a trained model gives to k-mers it has not seen."""
    return _judged_kmers(spark, sf_dir).select("kmer", "label", F.col("prediction").cast("int").alias("prediction"))


@query
def kmer_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class on those k-mers."""
    out = learning.report(_judged_kmers(spark, sf_dir))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each label has, against the least, the most and the mean."""
    rows = fixtures.planted(spark, sf_dir).select(S.error_number(F.col("type")).alias("label"))
    return learning.class_counts(rows)


def _classes(spark: SparkSession, sf_dir: str, sizes: list[int] = SIZES) -> DataFrame:
    """Classes by the genome of all sizes; only k-mers of the genome have a row."""
    counts = classify.counts_of(fixtures.genome(spark, sf_dir), sizes)
    return counts.select("kmer", classify.genome_class(F.col("n")).alias("class"))


def _scored_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, float]]:
    """Classes by the genome with z-scores by the reads, of all k-mers of either; and the score of k-mers that no read holds."""
    reads = classify.counts_of(fixtures.simulated(spark, sf_dir), SIZES)
    expected = _expected_rows(spark, sf_dir, SIZES)
    genome = classify.counts_of(fixtures.genome(spark, sf_dir), SIZES)
    flat = counting.learned_bias("IGNORE", K, 1.0, reads=reads)
    every = reads.select("kmer").unionByName(genome.select("kmer")).distinct()
    return classify.classified("CHEATING", every, reads, flat, expected, K, genome).select("kmer", "class", "z"), {r.k: -r.e / r.sd for r in expected.collect()}


@query
def grown_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of k-mers that grow in every way, at one place of each read."""
    reads = fixtures.simulated(spark, sf_dir).select("read_id", "seq", F.expr("cast(read_id % length(seq) as int)").alias("pos"))
    seq, pos = F.col("seq"), F.col("pos")
    ways = {
        "left": ladders.left_of(seq, pos, K),
        "right": ladders.right_of(seq, pos, K),
        "middle": ladders.middle(seq, pos, F.lit("A"), K),
        "without": ladders.middle(seq, pos, F.lit(""), K),
        "onward": ladders.onward(seq, pos, K),
        "after": ladders.onward_after(seq, pos, F.lit("SUB_FROM_A"), K, before=5),
        "one_way": ladders.one_way(seq, pos, F.lit("C"), True, True, K),
        "one_left": ladders.one_way(seq, pos, F.lit(""), True, False, K),
    }
    each = reads.select("read_id", F.inline(F.array(*[F.struct(F.lit(name).alias("way"), w.alias("ladder")) for name, w in ways.items()])))
    return ladders.decided(each, "ladder", _classes(spark, sf_dir), ["read_id", "way"], window=True).select("read_id", "way", "class", "window")


# True errors out of alignments.


@query
def alignment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.counters(fixtures.several(spark, sf_dir))


@query
def alignment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.grouped(fixtures.several(spark, sf_dir)).select("read_id", F.size("records").alias("n"), F.col("records")[0]["cigar"].alias("first"))


@query
def sequenced_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.sequenced(fixtures.several(spark, sf_dir))


@query
def alignment_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.ends(fixtures.several(spark, sf_dir))


@query
def clipped_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.clipped_places(fixtures.clipped(spark, sf_dir))


@query
def true_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_corrections(fixtures.alignments(spark, sf_dir), fixtures.genome(spark, sf_dir)).select("read_id", "orig_pos", "type")


@query
def true_corrections_both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truth.true_corrections(fixtures.alignments(spark, sf_dir, both_strands=True), fixtures.genome(spark, sf_dir))
    return found.select("read_id", "orig_pos", "type")


@query
def true_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_reads(fixtures.alignments(spark, sf_dir), fixtures.genome(spark, sf_dir))


# Error profiles.


@query
def overall_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.overall(fixtures.planted(spark, sf_dir), fixtures.simulated(spark, sf_dir))
    return found.select("type", "n", F.round("rate", 9).alias("rate"), F.round("log_p", 6).alias("log_p"))


@query
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = profiles.error_rates(profiles.overall(fixtures.planted(spark, sf_dir), fixtures.simulated(spark, sf_dir)))
    return rates.select(*[F.round(c, 9).alias(c) for c in rates.columns])


@query
def substitution_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.substitution_matrix(fixtures.planted(spark, sf_dir), fixtures.simulated(spark, sf_dir))


def _overall(spark: SparkSession, sf_dir: str) -> profiles.OverallProfile:
    return profiles.OverallProfile.learned(fixtures.planted(spark, sf_dir), fixtures.simulated(spark, sf_dir))


@query
def overall_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the overall profile says of every place of every read."""
    found = _overall(spark, sf_dir).read_scores(fixtures.simulated(spark, sf_dir))
    return found.select("read_id", "orig_pos", "type", F.round("score", 6).alias("score"))


@query
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reads' 11-mers on both strands that the overall profile lets expect for each genome 11-mer."""
    counts = classify.counts_of(fixtures.simulated(spark, sf_dir), [K - 1, K, K + 1])
    found = counting.expected_errors(counts, counting.count_forward(fixtures.genome(spark, sf_dir), K), _overall(spark, sf_dir).table())
    return found.select("kmer", F.round("n", 6).alias("n"))


@query
def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.motif_counts(fixtures.planted(spark, sf_dir), fixtures.simulated(spark, sf_dir))


def _motif_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fixtures.simulated(spark, sf_dir)
    strands = classify.counts_of(reads, list(range(1, profiles.LONGEST_MOTIF)))
    return profiles.motif_scores(profiles.motif_counts(fixtures.planted(spark, sf_dir), reads), strands)


@query
def motif_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every motif that could hold errors of a type, whether it does or not."""
    return _motif_scores(spark, sf_dir).select("motif", "pos", "type", F.round("z", 5).alias("z"))


@query
def printed_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.printed(_motif_scores(spark, sf_dir).withColumn("z", F.round("z", 5))).groupBy("type", "pos").agg(F.count("*").alias("n"))


@query
def strongest_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fixtures.planted(spark, sf_dir).join(fixtures.simulated(spark, sf_dir).select("read_id", "seq"), "read_id")
    return profiles.strongest(at, _motif_scores(spark, sf_dir)).select("read_id", "orig_pos", "type", F.round("z", 5).alias("z"))


@query
def motif_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the motif profile says of every place of every read."""
    found = profiles.MotifProfile(_motif_scores(spark, sf_dir)).read_scores(fixtures.simulated(spark, sf_dir))
    return found.select("read_id", "orig_pos", "type", F.round("score", 5).alias("score"))


@query
def likely_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest error of each base and gap by the motif profile's rounded scores."""
    return correction.most_likely_errors(motif_lookup(spark, sf_dir))


@query
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All possible errors of each read, ranked by the overall profile's rounded scores."""
    return correction.ranking(overall_lookup(spark, sf_dir).where("type not in ('CORRECT', 'NODEL')"), ["read_id"]).select("read_id", "rank", "orig_pos", "type")


def _features_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    at = fixtures.planted(spark, sf_dir).select("read_id", "orig_pos").distinct().join(fixtures.simulated(spark, sf_dir).select("read_id", "seq"), "read_id")
    at = at.withColumn("qual", F.expr("repeat(char(cast(40 + read_id % 30 as int)), length(seq))"))
    rows = features.features(at, kind, _motif_scores(spark, sf_dir))
    return rows.select("read_id", "orig_pos", *[F.round(f"`{n}`", 5).alias(n.replace(" ", "_")) for n in features.feature_names(kind)])


@query
def features_current_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the bases at all planted errors."""
    return _features_of(spark, sf_dir, "current_base")


@query
def features_next_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the gaps behind all planted errors' places."""
    return _features_of(spark, sf_dir, "next_gap")


@query
def kmer_score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the k-mers around one place of each read, with other bases in its place."""
    table, unseen = _scored_classes(spark, sf_dir)
    at = fixtures.simulated(spark, sf_dir).select("read_id", "seq", F.expr("read_id % length(seq)").alias("orig_pos"))
    found = features.kmer_scores(at, "current_base", table, unseen, K)
    names = [c for c in found.columns if c.startswith("k-merZ")]
    short = lambda n: n.replace("k-merZ ", "").replace(" '", "_").replace("'", "").replace("__", "_none")
    return found.select("read_id", "orig_pos", *[F.round(f"`{n}`", 4).alias(short(n)) for n in names])


@query
def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of base and gap training data as text, without the scores."""
    reads, planted = fixtures.simulated(spark, sf_dir).select("read_id", "seq"), fixtures.planted(spark, sf_dir)
    base, gap = features.observed(reads, planted)
    char = F.ascii(S.part_of(F.col("seq"), F.col("orig_pos"), 1))
    each = [t.select("read_id", "orig_pos", "label", char.alias("base"), F.length("seq").alias("size"), F.lit(name).alias("kind")) for name, t in (("base", base), ("gap", gap))]
    rows = each[0].unionByName(each[1])
    return rows.select("read_id", "kind", features.training_text(rows, ["base", "orig_pos", "size"]).alias("row"))


# Correction and its evaluation.


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_both(fixtures.genome(spark, sf_dir), K)


@query
def substitution_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.substitutions(fixtures.simulated(spark, sf_dir), _known(spark, sf_dir), K)


@query
def correct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, insertions and deletions by k-mers of one size."""
    return correction.by_kmers(fixtures.simulated(spark, sf_dir), _known(spark, sf_dir), K)


@query
def correct_reads_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from left to right: each place is judged with all places before it mended."""
    return in_order.by_kmers(fixtures.simulated(spark, sf_dir), _known(spark, sf_dir), K)


@query
def correct_reads_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by k-mers that grow while they are repetitive or leave a choice, as far as the read goes."""
    return correction.by_growing_kmers(fixtures.simulated(spark, sf_dir), lambda sizes: _classes(spark, sf_dir, sizes), K)


@query
def correct_reads_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest error of each untrusted k-mer, by the overall profile."""
    return correction.by_ranked_kmers(fixtures.simulated(spark, sf_dir), _overall(spark, sf_dir), _classes(spark, sf_dir), K)


@query
def correct_reads_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the motif profile holds likeliest at each place."""
    return correction.naive(fixtures.simulated(spark, sf_dir), profiles.MotifProfile(_motif_scores(spark, sf_dir).withColumn("z", F.round("z", 5))))


@query
def corrected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads after their planted errors are undone: the stretches they came from."""
    reads = fixtures.simulated(spark, sf_dir).withColumn("qual", F.expr("concat(repeat('+', 20), repeat('5', length(seq) - 20))"))
    out = correction.apply(reads, fixtures.planted(spark, sf_dir))
    return out.select("read_id", "corrected", F.length("corrected_qual").alias("qualities"), F.array_join("original_positions", " ").alias("places"))


@query
def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corrected read as text, with its corrections if it has any."""
    lines = correction_texts(spark, sf_dir).groupBy("read_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    out = corrected_reads(spark, sf_dir).select("read_id", "corrected").join(fixtures.simulated(spark, sf_dir).select("read_id", "seq"), "read_id").join(lines, "read_id", "left")
    return out.select("read_id", stores.corrected_text(F.col("seq"), F.col("corrected"), F.coalesce("lines", F.array().cast("array<string>"))).alias("printed"))


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.confusion(fixtures.planted(spark, sf_dir), substitution_corrections(spark, sf_dir), fixtures.simulated(spark, sf_dir))


@query
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query
def confusion_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without judging clipped places."""
    clipped = fixtures.simulated(spark, sf_dir).where("read_id % 20 = 11").select("read_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("orig_pos"))
    return correction.confusion(fixtures.planted(spark, sf_dir), substitution_corrections(spark, sf_dir), fixtures.simulated(spark, sf_dir), clipped)


@query
def correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correction.metrics(_confusion(spark, sf_dir))
    return found.select("category", *[F.round(c, 6).alias(c) for c in ("gain", "sensitivity", "specificity", "f1")])


@query
def correction_metrics_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each way of correcting finds the planted errors."""
    ways = {"fixed": correct_reads, "growing": correct_reads_growing, "naive": correct_reads_naive}
    out = None
    for mode, way in ways.items():
        table = correction.confusion(fixtures.planted(spark, sf_dir), way(spark, sf_dir), fixtures.simulated(spark, sf_dir))
        each = correction.metrics(table).select(F.lit(mode).alias("mode"), "category", *[F.round(c, 6).alias(c) for c in ("gain", "sensitivity", "specificity", "f1")])
        out = each if out is None else out.unionByName(each)
    return out


@query
def correction_metrics_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well correction in reading order finds the planted errors."""
    table = correction.confusion(fixtures.planted(spark, sf_dir), correct_reads_in_order(spark, sf_dir), fixtures.simulated(spark, sf_dir))
    return correction.metrics(table).select("category", *[F.round(c, 6).alias(c) for c in ("gain", "sensitivity", "specificity", "f1")])


@query
def closed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one shortest string of up to six bases that closes each gap of the gapped reads, and the read with it."""
    reads = fixtures.gapped(spark, sf_dir)
    fills = gaps.closed(reads, _known(spark, sf_dir), K, longest=6)
    return gaps.filled(reads, fills).join(fills, "read_id").select("read_id", "orig_pos", "fill", "ways", "corrected")


# Windows of any size.


@query
def unique_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest odd window from each place of the genome that neither strand holds elsewhere."""
    return suffixes.unique_windows(fixtures.genome(spark, sf_dir))


@query
def match_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the genome's strands go along with each read from each of its places, at least once and at least twice."""
    found = suffixes.matches(fixtures.genome(spark, sf_dir), fixtures.simulated(spark, sf_dir)).where("not of_genome")
    return found.select(F.col("id").alias("read_id"), "pos", "once", "twice")


@query
def grown_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the k-mer at every start of the reads, grown as far as the read goes while it is repetitive."""
    return suffixes.grown_starts(fixtures.genome(spark, sf_dir), fixtures.simulated(spark, sf_dir), K).drop("size")


#: Queries that bench.py times: one of each kind of work, on whole tables.
HEADLINE = (
    "kmer_count_both_strands", "kmer_count_forward", "sequence_functions", "error_candidates", "read_length_histogram", "expected_counts_circular", "expected_counts_linear",
    "bias_from_reference", "bias_from_reads", "bias_from_alignment", "bias_lookup", "kmer_classes", "kmer_rule_models", "true_corrections", "true_corrections_both_strands",
    "overall_profile", "substitution_matrix", "motif_counts", "motif_scores", "strongest_motif", "substitution_corrections", "corrected_reads", "confusion_counts", "correction_metrics",
    "correct_reads", "overall_lookup", "motif_lookup", "unique_windows",
)
