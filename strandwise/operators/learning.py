"""Models of k-mers and errors: training rows, a choice of the best of several models, and their use, on pyspark.ml.

Labels are the numbers of k-mer classes or error types. Everything random takes a seed and is decided row by row from a
hash of the row's key, so it does not depend on how rows are dealt. Defined cases: rows with a null feature are passed
over in training and get no class; no rows, or rows of one label only, raise an error.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import KMER_TYPES, kmer_type
from strandwise.operators import classify
from strandwise.session import written

# The features of k-mers, in the order of their training rows.
KMER_FEATURES = ("ZScore", "gcContent", "size", "observedCount", "biasCorrectedObservedCount", "expectedCountPusm")
#: Share of the rows that is kept from training to choose the best model by.
HELD_OUT = 0.34
MOST_ROWS = 500_000


def drawn(rows: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """About that share of the rows, by a hash of their keys."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def _border(buckets: DataFrame, want: DataFrame) -> DataFrame:
    """One row: the bucket (b) that holds the row with number `want` if rows are counted by bucket, and how many rows are wanted of it; the last bucket if there are fewer."""
    counts = buckets.groupBy("b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = counts.select("b", before.alias("before")).join(F.broadcast(want)).where("before < want")
    return met.agg(F.max("b").alias("b"), F.max_by(F.col("want") - F.col("before"), "b").alias("want"))


def least(rows: DataFrame, most: int, order: Column, key: str) -> DataFrame:
    """The `most` rows of least order (a hash: a long), ties by key: the rows of orderBy(order, key).limit(most) without sorting them all.

    Rows are counted by the first 16 bits of their order, those of the border bucket by the next 16; only those that share
    all 32 bits with the border are sorted. Keys must be unique, so these are few; the counts have 65,536 rows at most. rows are read four times.
    """
    hashed = rows.withColumn("__order", order)
    high, low = F.shiftright("__order", 48), F.pmod(F.shiftright("__order", 32), F.lit(1 << 16))
    hashed = hashed.withColumns({"__high": high, "__low": low})
    want = rows.sparkSession.range(1).select(F.lit(most).cast("long").alias("want"))
    first = _border(hashed.select(F.col("__high").alias("b")), want)
    inside = hashed.join(F.broadcast(first.select(F.col("b").alias("__b"))), F.col("__high") == F.col("__b")).drop("__b")
    second = _border(inside.select(F.col("__low").alias("b")), first.select("want"))
    marks = first.select(F.col("b").alias("__b")).crossJoin(F.broadcast(second.select(F.col("b").alias("__c"), "want")))
    met = hashed.join(F.broadcast(marks))
    sure = met.where((F.col("__high") < F.col("__b")) | ((F.col("__high") == F.col("__b")) & (F.col("__low") < F.col("__c"))))
    edge = met.where((F.col("__high") == F.col("__b")) & (F.col("__low") == F.col("__c")))
    edge = edge.withColumn("__rank", F.row_number().over(Window.orderBy("__order", key))).where(F.col("__rank") <= F.col("want"))
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))


def kmer_sample(reads: DataFrame, genome: DataFrame, k: int, seed: int = 1, most: int = MOST_ROWS) -> DataFrame:
    """kmer and label: at most `most` (and half of all that are possible) distinct k-mers, a third of them out of the genome, the others out of the reads.

    A bounded sample to fit a model on, taken by least hash; labelled by how often the genome's two strands hold a k-mer.
    """
    both = classify.counts_of(genome, [k])
    size = min(most, 4**k // 2)
    order = F.xxhash64(F.lit(seed), "kmer")
    first = written(least(written(classify.counting.count_forward(genome, k).select("kmer"), "sample-pool"), size // 3, order, "kmer"), "sample-first")
    rest = written(classify.counting.count_both(reads, k).select("kmer").join(first, "kmer", "left_anti"), "sample-pool")
    rest = least(rest, size - size // 3, order, "kmer")
    each = classify.by_genome(first.unionByName(rest), both)
    number = F.array_position(F.array(*map(F.lit, KMER_TYPES)), F.col("class")) - 1
    return each.select("kmer", number.cast("int").alias("label"))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight: all labels weigh the same together."""
    each = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = each.agg(F.sum("__n").alias("__all"), F.count("*").alias("__labels"))
    return rows.join(F.broadcast(each.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__labels") * F.col("__n"))).drop("__n", "__all", "__labels")


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, and the least, greatest and (rounded down) mean number of rows of all labels."""
    each = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = each.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.floor(F.sum("n") / F.count("*")).alias("mean"))
    return each.crossJoin(F.broadcast(whole))


def balanced(rows: DataFrame, seed: int, *keys: str, label: str = "label") -> DataFrame:
    """rows with as many of each label, about, as the labels have on average: frequent ones are drawn from, rare ones repeated."""
    counts = class_counts(rows, label)
    met = rows.join(F.broadcast(counts.select(label, "n", "mean")), label)
    share = F.col("mean") / F.col("n")
    chance = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000
    times = F.floor(share).cast("int") + F.when(chance < share - F.floor(share), 1).otherwise(0)
    return met.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("n", "mean", "__times", "__copy")


class RuleModel:
    """A model of k-mers that is a rule over two of their features; it learns nothing."""

    def __init__(self, name: str):
        self.name = name

    def transform(self, rows: DataFrame) -> DataFrame:
        rule = classify.rule_naive(F.col("biasCorrectedObservedCount"), F.col("expectedCountPusm")) if self.name == "naive" else classify.rule_statistical(F.col("ZScore"))
        return rows.withColumn("prediction", rule.cast("double"))


class GaussianModel:
    """Gaussian naive Bayes from one aggregate: rows of each label, and mean and variance of each feature within it.

    table: label, n and stats (an array of mean and variance, in the order of the features). As many rows as there are
    labels. Variances have 1e-9 of the greatest variance of a feature over all rows added, so none is 0 unless all are; then
    a feature without any variance takes no part. Equal scores go to the smaller label. Rows with a null feature get no row.
    """

    def __init__(self, table: DataFrame, features: list[str]):
        self.table, self.features = table, features

    @classmethod
    def learned(cls, rows: DataFrame, features: list[str], label: str = "label") -> GaussianModel:
        whole = rows.where(" and ".join(f"`{f}` is not null" for f in features)).select(F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
        each = whole.groupBy("label").agg(F.count("*").alias("n"), *[a(f).alias(f"{name}_{i}") for i, f in enumerate(features) for name, a in (("mean", F.avg), ("var", F.var_pop))])
        extra = whole.agg((F.lit(1e-9) * F.greatest(*[F.var_pop(f) for f in features], F.lit(0.0))).alias("extra"))
        stats = F.array(*[F.struct(F.col(f"mean_{i}").alias("mean"), (F.col(f"var_{i}") + F.col("extra")).alias("variance")) for i in range(len(features))])
        return cls(written(each.join(F.broadcast(extra)).select("label", "n", stats.alias("stats")), "gaussian-model"), features)

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows with scores: an array of (label, score), the score the log of prior times likelihood."""
        one = self.table.agg(F.sort_array(F.collect_list(F.struct("label", "n", "stats"))).alias("__model"), F.sum("n").alias("__all"))
        met = rows.where(" and ".join(f"`{f}` is not null" for f in self.features)).join(F.broadcast(one))

        def score(m: Column) -> Column:
            out = F.log(m["n"] / F.col("__all"))
            for i, f in enumerate(self.features):
                mean, variance = m["stats"][i]["mean"], m["stats"][i]["variance"]
                off = F.col(f).cast("double") - mean
                out = out + F.when(variance > 0, -0.5 * F.log(2 * math.pi * variance) - off * off / (2 * variance)).otherwise(0.0)
            return F.struct(m["label"].alias("label"), out.alias("score"))

        return met.withColumn("scores", F.transform("__model", score)).drop("__model", "__all")

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction, the label of the best score."""
        best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["label"]).alias("minus"))))
        return self.scores(rows).withColumn("prediction", (-best["minus"]).cast("double")).drop("scores")


def zoo(features: list[str], seed: int) -> dict[str, Pipeline]:
    """Four families of models over the features, three of them with balanced weights."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    models = {
        "GaussianNB": NaiveBayes(modelType="gaussian"),
        "DecisionTree": DecisionTreeClassifier(weightCol="weight", maxDepth=12, seed=seed),
        "RandomForest": RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=12, seed=seed),
        "LogisticRegression": LogisticRegression(weightCol="weight", maxIter=50),
    }
    return {name: Pipeline(stages=[vector, m.setLabelCol("label")]) for name, m in models.items()}


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def report(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support of each label that occurs or is predicted."""
    m = confusion_matrix(predictions)
    right = m.where("label = prediction").select(F.col("label").alias("l"), F.col("n").alias("right"))
    said = m.groupBy(F.col("prediction").alias("l")).agg(F.sum("n").alias("said"))
    held = m.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("support"))
    each = said.join(held, "l", "full").join(right, "l", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return each.select(
        F.col("l").alias("label"), share(F.col("right"), F.col("said")).alias("precision"), share(F.col("right"), F.col("support")).alias("recall"),
        share(2 * F.col("right"), F.col("said") + F.col("support")).alias("f1"), "support",
    )


def macro_f1(predictions: DataFrame) -> float:
    """The mean of all labels' F1, whatever their numbers of rows."""
    return report(predictions).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f")).first().f


def best_model(rows: DataFrame, features: list[str], seed: int, *keys: str, rules: tuple[str, ...] = ()) -> tuple[str, object, dict[str, float]]:
    """Name and model of the best macro F1 on held-out rows, and the F1 of all; rows have the features, label and keys."""
    held = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(HELD_OUT * 1_000_000)
    train, test = balanced_weights(rows.where(~held)), rows.where(held)
    found: dict[str, tuple[float, object]] = {}
    for name, pipeline in zoo(features, seed).items():
        model = pipeline.fit(train)
        found[name] = macro_f1(model.transform(test)), model
    for name in rules:
        found[name] = macro_f1(RuleModel(name).transform(test)), RuleModel(name)
    best = max(found, key=lambda n: found[n][0])  # the first of equal ones
    return best, found[best][1], {name: f for name, (f, _) in found.items()}


def save_model(model, path: str) -> None:  # noqa: ANN001
    """Store a model over whatever is there; a rule model is its name."""
    if isinstance(model, RuleModel):
        from pyspark.sql import SparkSession

        SparkSession.getActiveSession().createDataFrame([(model.name,)], "rule string").coalesce(1).write.mode("overwrite").text(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str):  # noqa: ANN201
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/stages")
    if top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(top):
        return PipelineModel.load(path)
    return RuleModel(spark.read.text(path).first().value)


def probabilities(model, rows: DataFrame, labels: list[int], keys: list[str]) -> DataFrame:  # noqa: ANN001
    """keys, label and p: a model's probability for each of the labels, 0 for those it never saw."""
    out = model.transform(rows).withColumn("__p", vector_to_array("probability"))
    pairs = F.array(*[F.struct(F.lit(i).alias("label"), F.coalesce(F.get("__p", F.lit(i)), F.lit(0.0)).alias("p")) for i in labels])
    return out.select(*keys, F.inline(pairs))


def classify_kmers(each: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """each (kmer, n, bias, e, z ...) with class by a model of KMER_FEATURES."""
    out = model.transform(classify.kmer_features(each))
    return out.select(*each.columns, kmer_type(F.col("prediction").cast("int")).alias("class"))


def train_kmer_model(reads: DataFrame, genome: DataFrame, k: int, bias: DataFrame, expected: DataFrame, seed: int = 1) -> tuple[str, object, dict[str, float]]:
    """The best model of k-mer classes; without a genome there is nothing to learn from, which raises an error."""
    if genome is None:
        raise ValueError("k-mer classes can't be learned without a genome")
    rows = training_rows(reads, genome, k, bias, expected, seed)
    return best_model(rows, list(KMER_FEATURES), seed, "kmer", rules=("naive", "statistical"))


def training_rows(reads: DataFrame, genome: DataFrame, k: int, bias: DataFrame, expected: DataFrame, seed: int = 1) -> DataFrame:
    """kmer, KMER_FEATURES and label."""
    each = classify.with_features(kmer_sample(reads, genome, k, seed), classify.counting.count_both(reads, k), bias, expected, k)
    return classify.kmer_features(each).select("kmer", *KMER_FEATURES, "label")


