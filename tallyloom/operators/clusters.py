"""Clusters: summaries, representatives, similarity of centroids, and families of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import as_vectors, centroid_distances, cosine, weighted_means

#: Items of no cluster.
NOISE = -1


def members(vectors: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item, cluster, frequency, idf, distance): the items of clusters, with their distance to its centre; unknown frequency and idf are 0."""
    real = vectors.where(F.col("cluster") != NOISE)
    d = centroid_distances(real).select("item", "cluster", F.round("distance", 6).alias("distance"))
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return d.join(frequency.select("item", "frequency", "idf"), "item", "left").select("item", "cluster", z("frequency"), z("idf"), "distance")


def _first(rows: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """(cluster, name): the first k items of each cluster in an order, joined by |."""
    r = F.row_number().over(W.partitionBy("cluster").orderBy(*order))
    kept = rows.withColumn("r", r).where(F.col("r") <= k)
    return kept.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "item"))), lambda x: x["item"].cast("string")), "|").alias(name))


def summary(rows: DataFrame) -> DataFrame:
    """(rank, cluster, size, mean_frequency, mean_idf, mean_distance, top_item, representative, top_items) of members; the largest first."""
    mean = lambda c: F.round((F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count("*")).cast("decimal(20,8)"), 4).cast("double").alias(f"mean_{c}")
    g = rows.groupBy("cluster").agg(F.count("*").alias("size"), mean("frequency"), mean("idf"), mean("distance"), F.min_by("item", F.struct(-F.col("frequency"), "item")).alias("top_item"), F.min_by("item", F.struct("distance", "item")).alias("representative"))
    g = g.join(_first(rows, [F.desc("frequency"), "item"], 5, "top_items"), "cluster")
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "cluster")))


def nearest(rows: DataFrame, k: int = 20) -> DataFrame:
    """(cluster, nearest): the k members nearest to the centre."""
    return _first(rows, ["distance", "item"], k, "nearest")


def most_frequent(rows: DataFrame, clusters: int = 50, k: int = 50) -> DataFrame:
    """(cluster, size, items): the k most frequent members of the largest clusters."""
    big = rows.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(clusters)
    return big.join(_first(rows, [F.desc("frequency"), "item"], k, "items"), "cluster")


def described(rows: DataFrame) -> DataFrame:
    """The summary with the nearest members beside it."""
    return summary(rows).join(nearest(rows), "cluster", "left")


def similarities(vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of the centres of each two clusters, a before b. There are as many rows as pairs of clusters."""
    c = as_vectors(weighted_means(vectors.where(F.col("cluster") != NOISE).withColumn("w", F.lit(1.0)), "cluster"), "cluster")
    a, b = c.select(F.col("cluster").alias("a"), F.col("vec").alias("x")), c.select(F.col("cluster").alias("b"), F.col("vec").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


def families(given: DataFrame, known: list[str], other: str = "other") -> DataFrame:
    """(cluster, family, confidence) by the likeliest tag of each cluster (cluster, tag, p): a known one names the family."""
    best = given.groupBy("cluster").agg(F.min_by(F.struct("tag", "p"), F.struct(-F.col("p"), "tag")).alias("x"))
    return best.select("cluster", F.when(F.col("x.tag").isin(known), F.col("x.tag")).otherwise(other).alias("family"), F.col("x.p").alias("confidence"))


def taxonomy(annotated: DataFrame, sizes: DataFrame) -> DataFrame:
    """(family, clusters, items, mean_confidence, members): members are the clusters of the family by falling size, joined by |."""
    j = annotated.join(sizes.select("cluster", "size"), "cluster", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    mean = F.round((F.sum(F.col("confidence").cast("decimal(18,4)")).cast("double") / F.count("*")).cast("decimal(20,8)"), 3).cast("double")
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "cluster"))), lambda x: x["cluster"].cast("string"))
    return j.groupBy("family").agg(F.count("*").alias("clusters"), F.sum("size").alias("items"), mean.alias("mean_confidence"), F.array_join(order, "|").alias("members"))
