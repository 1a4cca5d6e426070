import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import ml, ranks


def test_quantiles_equal_those_of_each_group(spark):
    r = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in r.integers(0, 40, 3000)] + [("wide", float(x)) for x in r.normal(size=2000)] + [("one", 5.0), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 9.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(11)
    shares = [0.0, 0.25, 0.33, 0.5, 0.9, 1.0]
    got = {x.g: (x.n, x.quantiles) for x in ranks.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"hot", "wide", "one", "two", None}
    for g, (n, q) in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        assert n == len(v) and np.allclose(q, np.quantile(v, shares), rtol=0, atol=1e-12)
    same = {x.g: x.q for x in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert same == {g: q for g, (_, q) in got.items()}
    assert np.allclose(ranks.quantiles(df, [], "v", [0.5]).first().quantiles, np.median([x for _, x in rows if x is not None]))
    assert ranks.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_description_has_no_buffer_of_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None)], "g string, v double")
    out = ml.described(df, "g", "v")
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert {tuple(r) for r in out.collect()} == {("a", 3, 2.333333, 2.0, 1.527525, 1.0, 4.0, 1.5, 3.0), ("b", 0, None, None, None, None, None, None, None)}
