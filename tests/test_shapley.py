from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tallyloom.operators import shapley
from tallyloom.plans import more

COLUMNS = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 6)).round(2)
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0.3, x[:, 2], -x[:, 3]) + 0.1 * x[:, 4]
    rows = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", label double")
    return rows, VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(rows)


def expectation(model_leaves, x, known):
    """The tree's value where features outside `known` go both ways, by the shares of the training rows."""
    total = 0.0
    for leaf in model_leaves:
        w = leaf.value
        for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            w *= (lo < x[f] <= hi) if f in known else share
        total += w
    return total


def brute(model_leaves, x):
    n = len(x)
    out = []
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        out.append(sum(factorial(s) * factorial(n - s - 1) / factorial(n) * (expectation(model_leaves, x, {*c, j}) - expectation(model_leaves, x, set(c))) for s in range(n) for c in combinations(rest, s)))
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest", "tree"])
def test_contributions_add_up_and_equal_all_subsets(spark, data, kind, monkeypatch):
    rows, x = data
    made = {"boosted": GBTRegressor(maxIter=4, maxDepth=5, seed=1, labelCol="label", featuresCol="v", stepSize=0.3), "forest": RandomForestRegressor(numTrees=3, maxDepth=4, seed=1, labelCol="label", featuresCol="v"), "tree": DecisionTreeRegressor(maxDepth=6, labelCol="label", featuresCol="v")}[kind]
    model = made.fit(x)
    guess = {r.id: r.prediction for r in model.transform(x).select("id", "prediction").collect()}
    told = {r.id: r for r in shapley.explained(rows.repartition(3), model, COLUMNS).collect()}
    assert len(told) == 600
    assert max(abs(sum(r.contributions) + r.base - guess[i]) for i, r in told.items()) < 1e-9
    known = shapley.leaves(spark, model)
    for i in (0, 17, 333):
        assert np.allclose(told[i].contributions, brute(known, [told[i][c] for c in COLUMNS]), atol=1e-10)
    monkeypatch.setattr(shapley, "TABLE", 2)  # long paths
    x17 = np.array([[told[i][c] for c in COLUMNS] for i in (0, 17, 333)])
    assert np.allclose(shapley.contributions(known, shapley._tables(known), x17), [told[i].contributions for i in (0, 17, 333)])


def test_missing_values_and_clashing_names(spark, data):
    rows, x = data
    model = DecisionTreeRegressor(maxDepth=3, labelCol="label", featuresCol="v").fit(x)
    odd = rows.limit(4).withColumn("f0", F.when(F.col("id") > 1, F.col("f0"))).withColumns({"x": F.lit("keep"), "x0": F.lit(1)})
    got = shapley.explained(odd, model, COLUMNS).collect()
    assert len(got) == 4 and all(r.x == "keep" and len(r.contributions) == 6 for r in got)
    right = VectorAssembler(inputCols=COLUMNS, outputCol="v", handleInvalid="keep").transform(rows.limit(4).withColumn("f0", F.when(F.col("id") > 1, F.col("f0")).otherwise(float("nan"))))
    guess = {r.id: r.prediction for r in model.transform(right).collect()}
    assert all(abs(sum(r.contributions) + r.base - guess[r.id]) < 1e-9 for r in got)
    assert shapley.explained(rows.limit(0), model, COLUMNS).count() == 0


def test_summaries(spark, data):
    rows, x = data
    model = GBTRegressor(maxIter=3, maxDepth=4, seed=1, labelCol="label", featuresCol="v").fit(x)
    told = shapley.explained(shapley.sampled(rows, ["id"], 200), model, COLUMNS)
    phi = np.array([r.contributions for r in told.collect()])
    assert len(phi) == 200
    assert {r.feature: r.mean_abs for r in shapley.mean_contributions(told, COLUMNS).collect()} == pytest.approx(dict(zip(COLUMNS, np.abs(phi).mean(0))), abs=1e-6)
    effect = shapley.feature_effect(told, COLUMNS, "f0").first()
    assert effect.mean_abs == pytest.approx(np.abs(phi[:, 0]).mean(), abs=1e-6) and effect.positive == pytest.approx((phi[:, 0] > 0).mean(), abs=1e-6) and effect.high > 0
    some = {r.id for r in shapley.sampled(rows, ["id"], 200).collect()}
    assert some == {r.id for r in shapley.sampled(rows.repartition(7), ["id"], 200).collect()}


def test_all_rows_are_explained(spark, monkeypatch):
    n = 3500  # more than were explained once
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 6)).round(3)
    columns = more.FEATURES
    rows = spark.createDataFrame([(i % 5, i, *map(float, a), float(a[0] + a[1])) for i, a in enumerate(x)], "leader long, item long, " + ", ".join(f"{c} double" for c in columns) + ", label double").repartition(5)
    model = DecisionTreeRegressor(maxDepth=4, labelCol="label", featuresCol="v").fit(VectorAssembler(inputCols=columns, outputCol="v").transform(rows))
    monkeypatch.setattr(more, "_trained", lambda t: (model, rows))
    monkeypatch.setattr(more, "_two_models", lambda t: {"full": (model, rows, columns)})
    known = shapley.leaves(spark, model)
    phi = shapley.contributions(known, shapley._tables(known), x)
    cut = np.quantile(x[:, 0], [0.33, 0.66])
    effect = more._shap_cosine(None).first()
    want = [np.abs(phi[:, 0]).mean(), (phi[:, 0] > 0).mean(), np.abs(phi[x[:, 0] < cut[0], 0]).mean(), np.abs(phi[x[:, 0] > cut[1], 0]).mean()]
    assert [effect.mean_abs, effect.positive, effect.low, effect.high] == pytest.approx(want, abs=1e-6)
    assert {m.feature: m.mean_abs for m in more._shap(None).collect()} == pytest.approx(dict(zip(columns, np.abs(phi).mean(0))), abs=1e-6)
