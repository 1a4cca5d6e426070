"""Tags and clusters: conditional probabilities and the predictors built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_kind(rows: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """predict(rows) for rows (item, *columns) and a prediction (item, ...) that depends on the rows of an item alone.

    Items with equal rows are one kind, which is predicted once; items are dealt before anything grows with clusters or leaders.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.select("item", F.struct(*columns).alias("row")).repartition(n, "item").groupBy("item").agg(F.sort_array(F.collect_list("row")).alias("kind"))
    found = predict(lists.select("kind").distinct().select(F.col("kind").alias("item"), F.explode("kind").alias("row")).select("item", "row.*"))
    return lists.join(found.withColumnRenamed("item", "kind"), "kind").select("item", *[c for c in found.columns if c != "item"])


def tagged(tags: DataFrame, vectors: DataFrame) -> DataFrame:
    return tags.join(vectors.select("item", "cluster"), "item").select("item", "tag", "cluster")


def cluster_given_tag(rows: DataFrame, least: int = 5) -> DataFrame:
    """(tag, cluster, p) of tags with at least `least` rows."""
    n = rows.groupBy("tag").agg(F.count_distinct("item").alias("n"), F.count("*").alias("rows")).where(F.col("rows") >= least)
    return rows.groupBy("tag", "cluster").agg(F.count_distinct("item").alias("m")).join(n, "tag").select("tag", "cluster", F.round(F.col("m") / F.col("n"), 4).alias("p"))


def tag_given_cluster(rows: DataFrame) -> DataFrame:
    """(cluster, tag, p)."""
    n = rows.groupBy("cluster").agg(F.count_distinct("item").alias("n"))
    return rows.groupBy("cluster", "tag").agg(F.count_distinct("item").alias("m")).join(n, "cluster").select("cluster", "tag", F.round(F.col("m") / F.col("n"), 4).alias("p"))


def semantics(given: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, tags): the k likeliest tags of each cluster, joined."""
    r = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("p"), "tag"))
    return given.withColumn("r", r).where(F.col("r") <= k).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), "|").alias("tags"))


def additive_prediction(item_tags: DataFrame, given: DataFrame, k: int = 5) -> DataFrame:
    """(item, rank, cluster, score): the sum of P(cluster | tag), normalised over all clusters, then the k best."""

    def predict(item_tags: DataFrame) -> DataFrame:
        s = item_tags.select("item", "tag").distinct().join(given, "tag").groupBy("item", "cluster").agg(F.sum("p").alias("s"))
        s = s.withColumn("score", F.round(F.col("s") / F.sum("s").over(W.partitionBy("item")), 6))
        return s.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "cluster"))).where(F.col("rank") <= k).select("item", "rank", "cluster", "score")

    return by_kind(item_tags, ["tag"], predict)


def bayes_prediction(item_tags: DataFrame, rows: DataFrame, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """(item, rank, cluster, p): multinomial naive Bayes with smoothed tag counts and unsmoothed priors.

    A tag that a cluster lacks counts as alpha: its log weight is a constant of the cluster, so only
    seen (tag, cluster) pairs are joined and the rest is added once for each cluster.
    """

    def predict(item_tags: DataFrame) -> DataFrame:
        size = rows.agg(F.count_distinct("tag").alias("v"))
        per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("item").alias("docs"))
        total = per.agg(F.sum("docs").alias("all"))
        prior = per.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).select("cluster", F.log(F.col("docs") / F.col("all")).alias("prior"), (F.log(F.lit(alpha)) - F.log(F.col("n") + alpha * F.col("v"))).alias("absent"))
        seen = rows.groupBy("tag", "cluster").agg(F.count("*").alias("m")).select("tag", "cluster", (F.log(F.col("m") + alpha) - F.log(F.lit(alpha))).alias("more"))
        known = item_tags.select("item", "tag").join(rows.select("tag").distinct(), "tag", "left_semi")
        base = known.groupBy("item").agg(F.count("*").alias("t")).crossJoin(F.broadcast(prior)).select("item", "cluster", (F.col("prior") + F.col("t") * F.col("absent")).alias("base"))
        more = known.join(seen, "tag").groupBy("item", "cluster").agg(F.sum("more").alias("more"))
        s = base.join(more, ["item", "cluster"], "left").withColumn("l", F.col("base") + F.coalesce("more", F.lit(0.0)))
        w = W.partitionBy("item")
        s = s.withColumn("e", F.exp(F.col("l") - F.max("l").over(w))).withColumn("p", F.round(F.col("e") / F.sum("e").over(w), 6))
        return s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "cluster"))).where(F.col("rank") <= k).select("item", "rank", "cluster", "p")

    return by_kind(item_tags, ["tag"], predict)


def leader_weights(profile: DataFrame, vectors: DataFrame) -> DataFrame:
    """(leader, cluster, weight, mean): share of the leader's TF-IDF, and its mean, in each cluster."""
    g = profile.join(vectors.select("item", "cluster"), "item").groupBy("leader", "cluster").agg(F.sum("tfidf_norm").alias("s"), F.avg("tfidf_norm").alias("mean"))
    all_ = F.sum("s").over(W.partitionBy("leader"))
    return g.select("leader", "cluster", F.round(F.when(all_ == 0, F.col("s")).otherwise(F.col("s") / F.when(all_ == 0, 1.0).otherwise(all_)), 6).alias("weight"), "mean")


def leader_prediction(prediction: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(item, rank, leader, score): sum of score * mean, by the largest."""

    def predict(prediction: DataFrame) -> DataFrame:
        s = prediction.join(weights, "cluster").groupBy("item", "leader").agg(F.sum(F.col("score") * F.col("mean")).alias("s"))
        top = F.max("s").over(W.partitionBy("item"))
        s = s.withColumn("score", F.round(F.coalesce(F.try_divide("s", top), F.lit(0.0)), 9))
        return s.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "leader"))).where(F.col("rank") <= k).select("item", "rank", "leader", "score")

    return by_kind(prediction, ["cluster", "score"], predict)


def accuracy(prediction: DataFrame, vectors: DataFrame) -> DataFrame:
    """(items, top1, top3, top5): share of items whose cluster is among the first predicted."""
    hit = prediction.withColumnRenamed("cluster", "guess").join(vectors.select("item", "cluster"), "item").groupBy("item").agg(F.min(F.when(F.col("guess") == F.col("cluster"), F.col("rank"))).alias("r"))
    share = lambda n: F.round(F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)), 6)
    return hit.agg(F.count("*").alias("items"), share(1).alias("top1"), share(3).alias("top3"), share(5).alias("top5"))


def cosine_prediction(item_tags: DataFrame, given: DataFrame, k: int = 5) -> DataFrame:
    """(item, rank, cluster, score): cosine of TF-IDF, of the item's tags to a document for each cluster that repeats a tag max(1, int(10 p)) times.

    given: (cluster, tag, p). idf is ln((1 + clusters) / (1 + clusters with the tag)) + 1; tags that no cluster has don't count.
    """

    def predict(item_tags: DataFrame) -> DataFrame:
        doc = given.select("cluster", "tag", F.greatest(F.lit(1), F.floor(10 * F.col("p"))).alias("tf"))
        n = doc.agg(F.count_distinct("cluster").alias("n"))
        idf = doc.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("tag", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
        d = doc.join(idf, "tag").select("cluster", "tag", (F.col("tf") * F.col("idf")).alias("d"))
        d_norm = d.groupBy("cluster").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("dn"))
        q = item_tags.groupBy("item", "tag").agg(F.count("*").alias("tf")).join(idf, "tag").select("item", "tag", (F.col("tf") * F.col("idf")).alias("q"))
        q_norm = q.groupBy("item").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
        s = q.join(d, "tag").groupBy("item", "cluster").agg(F.sum(F.col("q") * F.col("d")).alias("s")).join(q_norm, "item").join(d_norm, "cluster")
        s = s.select("item", "cluster", F.round(F.col("s") / (F.col("qn") * F.col("dn")), 6).alias("score")).where("score > 0")
        return s.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "cluster"))).where(F.col("rank") <= k).select("item", "rank", "cluster", "score")

    return by_kind(item_tags, ["tag"], predict)


def discriminant(given: DataFrame, least: float = 0.5, k: int = 20) -> DataFrame:
    """(rank, tag, clusters, most): the k tags with the largest P(cluster | tag), over `least`; clusters: those over 0.1."""
    g = given.groupBy("tag").agg(F.count_if(F.col("p") > 0.1).alias("clusters"), F.max("p").alias("most")).where(F.col("most") > least)
    return g.orderBy(F.desc("most"), "tag").limit(k).withColumn("rank", F.row_number().over(W.orderBy(F.desc("most"), "tag"))).select("rank", "tag", "clusters", "most")


def eligible(rows: DataFrame, least: int = 3, k: int = 500, seed: int = 42) -> DataFrame:
    """(item): k of the items with at least so many tags, the first by a keyed hash."""
    some = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    return some.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "item")), "item").limit(k)


def accuracy_by_cluster(predictions: dict[str, DataFrame], vectors: DataFrame, sample: DataFrame) -> DataFrame:
    """(method, cluster, items, top1, top3, top5) of predictions (item, rank, cluster) over a sample (item), by true cluster."""
    own = vectors.select("item", "cluster").join(sample.select("item"), "item", "left_semi")
    share = lambda n: F.round(F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)), 6)
    parts = []
    for method, p in predictions.items():
        hit = own.join(p.select("item", "rank", F.col("cluster").alias("guess")), "item", "left").groupBy("item", "cluster").agg(F.min(F.when(F.col("guess") == F.col("cluster"), F.col("rank"))).alias("r"))
        parts.append(hit.groupBy("cluster").agg(F.count("*").alias("items"), share(1).alias("top1"), share(3).alias("top3"), share(5).alias("top5")).withColumn("method", F.lit(method)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profiles(rows: DataFrame, families: DataFrame, k: int = 5) -> DataFrame:
    """(item, cluster, family, tags): the first k tags of each item, joined, with its cluster and that cluster's family."""
    own = rows.groupBy("item").agg(F.min("cluster").alias("cluster"), F.array_join(F.slice(F.sort_array(F.collect_list("tag")), 1, k), "|").alias("tags"))
    return own.join(families.select("cluster", "family"), "cluster", "left").select("item", "cluster", F.coalesce("family", F.lit("")).alias("family"), "tags")
