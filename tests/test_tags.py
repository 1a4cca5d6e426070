import re

from pyspark.sql import functions as F

from tallyloom.operators import tags


def test_equal_items_are_predicted_once(spark):
    told = spark.range(2000).select(F.col("id").alias("item"), F.explode(F.array((F.col("id") % 3).cast("string"), F.lit("x"))).alias("tag"))
    given = spark.createDataFrame([("0", 1, 0.5), ("1", 2, 0.75), ("x", 1, 0.25)], "tag string, cluster int, p double")
    seen = []

    def predict(rows):
        seen.append(rows.count())
        return rows.groupBy("item").agg(F.count("*").alias("n"))

    assert {(r.n, r["count"]) for r in tags.by_kind(told, ["tag"], predict).groupBy("n").count().collect()} == {(2, 2000)}
    assert seen == [6]
    got = {(r.item, r["rank"]): (r.cluster, r.score) for r in tags.additive_prediction(told, given).collect()}
    want = {0: [(1, 1.0)], 1: [(2, 0.75), (1, 0.25)], 2: [(1, 1.0)]}
    assert got == {(i, n + 1): x for i in range(2000) for n, x in enumerate(want[i % 3])}


def test_baskets_meet_once(spark, tmp_path):
    from tallyloom.sources.driver_tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.basket_items()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(basket_id#\d+L?, leader", plan)  # rows are not dealt again to find alike ones
    old = t.lines().join(t.items().where("kind <> 'ECONOMY'").select("item"), "item").select("basket_id", "leader", "item").distinct()
    assert sorted(map(tuple, t.basket_items().collect())) == sorted(map(tuple, old.collect()))
