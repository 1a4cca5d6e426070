"""Readings of hybrid scores: explanations, items that no basket holds yet, and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hybrid import exact
from .tags import by_kind


def unseen_items(prediction: DataFrame, weights: DataFrame, clusters: DataFrame, frequency: DataFrame, least: float = 0.01, k: int = 10) -> DataFrame:
    """(item, rank, leader, probability, cluster, confidence, popularity) of items known by tags only.

    prediction: (item, rank, cluster, p), of which those over `least` count. A leader's probability
    is the sum of p * weight by the largest; popularity is the mean frequency of the known items of
    the likeliest cluster (clusters: item, cluster).
    """
    known = clusters.join(frequency.select("item", "frequency"), "item").groupBy("cluster").agg(F.round((F.sum(exact("frequency", 4)).cast("double") / F.count("*")).cast("decimal(20,8)"), 2).cast("double").alias("popularity"))

    def predict(p: DataFrame) -> DataFrame:
        top = p.where("rank = 1").select("item", "cluster", F.round("p", 4).alias("confidence"))
        s = p.join(weights.select("leader", "cluster", "weight"), "cluster").groupBy("item", "leader").agg(F.sum(exact("p", 6) * exact("weight", 6)).cast("double").alias("s"))
        best = F.max("s").over(W.partitionBy("item"))
        s = s.withColumn("probability", F.round(F.coalesce(F.try_divide("s", best), F.lit(0.0)), 4))
        s = s.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("s"), "leader"))).where(F.col("rank") <= k)
        return s.join(top, "item").join(known, "cluster", "left").select("item", "rank", "leader", "probability", "cluster", "confidence", F.coalesce("popularity", F.lit(0.0)).alias("popularity"))

    return by_kind(prediction.where(F.col("p") > least), ["rank", "cluster", "p"], predict)


def explanations(hybrids: DataFrame, rates: DataFrame) -> DataFrame:
    """(leader, item, hybrid, rate, reasons, caveats): what speaks for an item, and against, by thresholds of its scores (fixed values); joined by |."""
    j = hybrids.join(rates.select("leader", "item", "rate"), ["leader", "item"], "left")
    t, c, w, g = (F.col(x) for x in ("tfidf_norm", "cosine", "weight", "tag_score"))
    reasons = F.array(
        F.when(t > 0.6, "characteristic of the leader").when(t > 0, "played with the leader"),
        F.when(c > 0.5, "close to the leader").when(c > 0.2, "near to the leader"),
        F.when(w > 0, "in a cluster of the leader"),
        F.when(g > 0.1, "tags suit the leader"),
    )
    caveats = F.array(F.when(t == 0, "no history with the leader"), F.when((w > 0) & (w < 0.05), "cluster is rare with the leader"))
    joined = lambda a: F.array_join(F.array_compact(a), "|")
    return j.select("leader", "item", "hybrid", F.coalesce("rate", F.lit(0.0)).alias("rate"), joined(reasons).alias("reasons"), joined(caveats).alias("caveats"))


def batch(hybrids: DataFrame, wanted: DataFrame, k: int = 50) -> DataFrame:
    """(leader, rank, item, hybrid): the wanted items (item) of each leader by falling score."""
    j = hybrids.join(wanted.select("item").distinct(), "item", "left_semi")
    return j.withColumn("rank", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("hybrid"), "item"))).where(F.col("rank") <= k).select("leader", "rank", "item", "hybrid")


def separation(hybrids: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(leader, in_theme, off_theme, separation): mean score of the items of the leader's main cluster, of those of others, and the difference."""
    main = weights.groupBy("leader").agg(F.min_by("cluster", F.struct(-F.col("weight"), "cluster")).alias("main"))
    j = hybrids.join(vectors.select("item", "cluster"), "item").join(main, "leader").withColumn("inside", F.col("cluster") == F.col("main"))
    mean = lambda yes: F.round((F.sum(F.when(F.col("inside") == yes, exact("hybrid", 4))).cast("double") / F.count_if(F.col("inside") == yes)).cast("decimal(20,8)"), 6)
    m = j.groupBy("leader").agg(mean(True).alias("a"), mean(False).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return m.select("leader", F.col("a").cast("double").alias("in_theme"), F.col("b").cast("double").alias("off_theme"), (F.col("a") - F.col("b")).cast("double").alias("separation"))
