"""Rates, frequencies, inverse group frequency and TF-IDF profiles of leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leader_rates(items: DataFrame, baskets: DataFrame) -> DataFrame:
    """(leader, item, n, total, rate): rate is the percentage of the leader's baskets, empty ones included, that hold the item."""
    total = baskets.groupBy("leader").agg(F.count("*").alias("total"))
    n = items.groupBy("leader", "item").agg(F.count("*").alias("n"))
    return n.join(total, "leader").select("leader", "item", "n", "total", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("rate"))


def global_frequency(items: DataFrame, baskets: DataFrame) -> DataFrame:
    """(item, n, total, frequency, leaders, idf): idf is ln(leaders with items / leaders of the item), unsmoothed."""
    scale = baskets.agg(F.count("*").alias("total")).crossJoin(items.agg(F.count_distinct("leader").alias("all_leaders")))
    # counted by leader first, so that a common item is one row a leader before the second count
    n = items.groupBy("item", "leader").agg(F.count("*").alias("n")).groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("leaders"))
    return n.crossJoin(F.broadcast(scale)).select("item", "n", "total", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("frequency"), "leaders", F.round(F.log(F.col("all_leaders") / F.col("leaders")), 6).alias("idf"))


def tfidf(rates: DataFrame, frequency: DataFrame) -> DataFrame:
    """(leader, item, rate, idf, tfidf, tfidf_norm), from the rounded rate and idf; an item without idf has 0."""
    j = rates.select("leader", "item", "rate").join(frequency.select("item", "idf"), "item", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0))).withColumn("t", F.col("rate") / 100 * F.col("idf"))
    top = F.max("t").over(W.partitionBy("leader"))
    return j.select("leader", "item", "rate", "idf", F.round("t", 6).alias("tfidf"), F.round(F.when(top == 0, 0.0).otherwise(F.col("t") / F.when(top == 0, 1.0).otherwise(top)), 6).alias("tfidf_norm"))


def signatures(profile: DataFrame, k: int = 20) -> DataFrame:
    """The k items of each leader with the largest TF-IDF, ranked; ties by item."""
    rank = F.row_number().over(W.partitionBy("leader").orderBy(F.desc("tfidf"), "item"))
    return profile.withColumn("rank", rank).where(F.col("rank") <= k)


def summary(profile: DataFrame, rates: DataFrame) -> DataFrame:
    """(leader, deck_count, unique_items, mean_tfidf, max_tfidf, top_item)."""
    own = profile.groupBy("leader").agg(F.count("*").alias("unique_items"), F.round(F.avg("tfidf"), 4).alias("mean_tfidf"), F.max("tfidf").alias("max_tfidf"), F.min_by("item", F.struct(-F.col("tfidf"), "item")).alias("top_item"))
    return own.join(rates.groupBy("leader").agg(F.max("total").alias("deck_count")), "leader")
