"""Models on small made-up rows."""

import pytest
from pyspark.sql import functions as F

from strandwise.operators import learning


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"k{i}", float(i % 3) + (i % 7) / 20, float(i % 5), i % 3) for i in range(240)] + [(f"r{i}", 1.0, 2.0, 1) for i in range(60)]
    return spark.createDataFrame(made, "kmer string, a double, b double, label int").coalesce(1).cache()


def test_weights_and_balance(rows):
    assert {r.label: round(r.w, 6) for r in learning.balanced_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()} == {0: 100.0, 1: 100.0, 2: 100.0}
    counts = {r.label: r for r in learning.class_counts(rows).collect()}
    assert (counts[0].n, counts[1].n, counts[0].least, counts[0].most, counts[0].mean) == (80, 140, 80, 140, 100)
    even = {r.label: r["count"] for r in learning.balanced(rows, 3, "kmer").groupBy("label").count().collect()}
    assert all(70 <= n <= 130 for n in even.values())


def test_report(spark):
    said = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 1.0), (1, 1.0), (2, 1.0)], "label int, prediction double").coalesce(1)
    found = {r.label: r for r in learning.report(said).collect()}
    assert (found[1].precision, found[1].recall, found[0].f1, found[2].f1) == (0.5, 1.0, 2 / 3, 0.0)
    assert abs(learning.macro_f1(said) - (2 / 3 + 2 / 3 + 0) / 3) < 1e-9


def test_best_model_is_kept(spark, rows, tmp_path, monkeypatch):
    zoo = learning.zoo
    monkeypatch.setattr(learning, "zoo", lambda features, seed: {k: v for k, v in zoo(features, seed).items() if k in ("GaussianNB", "DecisionTree")})
    name, model, scores = learning.best_model(rows, ["a", "b"], 1, "kmer")
    assert set(scores) == {"GaussianNB", "DecisionTree"} and scores[name] == max(scores.values()) > 0.95
    learning.save_model(model, str(tmp_path / "m"))
    again = learning.load_model(str(tmp_path / "m"))
    p = learning.probabilities(again, rows.limit(5), [0, 1, 2, 3], ["kmer"]).groupBy("kmer").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    assert all(abs(r.p - 1) < 1e-6 and r.n == 4 for r in p)
    learning.save_model(learning.RuleModel("naive"), str(tmp_path / "rule"))
    assert learning.load_model(str(tmp_path / "rule")).name == "naive"


@pytest.mark.parametrize("most", [0, 1, 50, 299, 300, 1000])
def test_least_rows(rows, most):
    for order in (F.xxhash64("kmer"), F.pmod(F.xxhash64("kmer"), F.lit(7)).cast("long"), F.shiftleft(F.pmod(F.xxhash64("kmer"), F.lit(9)).cast("long"), 32)):
        found = learning.least(rows, most, order, "kmer")
        assert found.columns == rows.columns
        assert sorted(found.collect()) == sorted(rows.orderBy(order, "kmer").limit(most).collect())


def test_least_rows_of_none_and_without_one_sort(rows):
    assert learning.least(rows.where("label > 9"), 5, F.xxhash64("kmer"), "kmer").count() == 0
    plan = learning.least(rows, 5, F.xxhash64("kmer"), "kmer")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan


def test_gaussian_model(spark, rows):
    import math

    more = rows.unionByName(spark.createDataFrame([("n", None, 1.0, 2)], rows.schema)).withColumn("flat", F.lit(3.0))
    features = ["a", "b", "flat"]
    model = learning.GaussianModel.learned(more, features)
    data = [(r.a, r.b, 3.0, r.label) for r in rows.collect()]
    extra = 1e-9 * max(sum((x[i] - sum(y[i] for y in data) / len(data)) ** 2 for x in data) / len(data) for i in range(3))
    stats = {}
    for label in (0, 1, 2):
        own = [x for x in data if x[3] == label]
        means = [sum(x[i] for x in own) / len(own) for i in range(3)]
        stats[label] = len(own), means, [sum((x[i] - means[i]) ** 2 for x in own) / len(own) + extra for i in range(3)]

    def score(x, label):
        n, means, variances = stats[label]
        return math.log(n / len(data)) + sum(-0.5 * math.log(2 * math.pi * v) - (a - m) ** 2 / (2 * v) for a, m, v in zip(x, means, variances))

    found = model.scores(more).collect()
    assert len(found) == len(data)
    for r in found:
        assert [s.label for s in r.scores] == [0, 1, 2] and all(abs(s.score - score((r.a, r.b, 3.0), s.label)) < 1e-6 for s in r.scores)
    said = {r.kmer: r.prediction for r in model.transform(more).collect()}
    assert said == {r.kmer: float(max((0, 1, 2), key=lambda t: (score((r.a, r.b, 3.0), t), -t))) for r in found}
    assert learning.macro_f1(model.transform(more)) > 0.8
