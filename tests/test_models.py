import numpy as np

from tallyloom.operators import ml
from tallyloom.plans import queries


def test_models_do_not_hang_on_how_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(ml, "TASK", 5)
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2))
    y = x[:, 0] + np.where(x[:, 1] > 0, 1.0, 0.0)
    rows = spark.createDataFrame([(i % 5, i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "leader long, item long, a double, b double, label double")
    got = []
    for lying in (rows.coalesce(1), rows.repartition(3, "leader")):
        guess = ml.rate_model(lying, ml.held_out(lying, "leader"), ["a", "b"], rounds=3)[1]
        assert guess.rdd.getNumPartitions() == 4
        got.append({g.item: g.prediction for g in guess.collect()})
    assert len(got[0]) == 80 and got[0] == got[1]


def test_features_need_no_hybrid_scores(spark, monkeypatch):
    monkeypatch.setattr(queries.Derived, "hybrids", None)
    rows = queries._features(queries.Derived(spark, "/root/testdata/sf0.001"))
    assert rows.count() == queries.Derived(spark, "/root/testdata/sf0.001").profile().count() and rows.where("cosine <> 0").count() > 0
