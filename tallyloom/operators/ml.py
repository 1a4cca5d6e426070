"""Features, group hold-out, ranking metrics, and the models of pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .density import NOISE, dense_clusters
from .hybrid import compatible, leader_cosine
from .layout import laid_out
from .ranks import quantiles
from .skipgram import SUBSAMPLE, skip_gram

#: Numbers of k-means groups that are tried, coordinates of the layout, and the floors of clusters by density (fixed values).
KS, PLACES, LEAST_SILHOUETTE, LEAST_GROUPS = (25, 50, 75), 20, 0.05, 10
#: Rows of a model's task, as powers of two: at least, while there are no more tasks than shuffles have, and about, beyond that.
TASK, LARGE_TASK = 15, 20


def features(profile: DataFrame, frequency: DataFrame, items: DataFrame, vectors: DataFrame, leaders: DataFrame, item_colours: DataFrame, leader_colours: DataFrame) -> DataFrame:
    """(leader, item, cosine, tfidf_norm, idf, cost, frequency, compatible, label): label is ln(1 + rate); missing values are 0, unknown colours fit.

    leaders: (leader, leader_vec). The profile meets all else by item, in one pass.
    """
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    j = profile.join(frequency.select("item", "frequency"), "item", "left").join(items.select("item", F.col("cost").cast("double").alias("cost")), "item", "left")
    j = j.join(item_colours.select("item", F.col("colours").alias("ic")), "item", "left").join(leader_colours.select("leader", F.col("colours").alias("lc")), "leader", "left")
    j = j.join(vectors.select("item", "vec"), "item", "left").join(leaders, "leader", "left").withColumn("cosine", F.round(leader_cosine(F.col("vec"), F.col("leader_vec")), 6))
    return j.select("leader", "item", "cosine", z("tfidf_norm"), z("idf"), z("cost"), z("frequency"), compatible(F.col("ic"), F.col("lc")).cast("double").alias("compatible"), F.round(F.log1p("rate"), 6).alias("label"))


def held_out(groups: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """(key, held_out): whole groups, the first ceil(share * groups) by the md5 of the key."""
    w = W.orderBy("h", key)
    d = groups.select(key).distinct().withColumn("h", F.md5(F.col(key).cast("string")))
    n = d.agg(F.count("*").alias("n"))
    return d.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(n)).select(key, (F.col("r") <= F.ceil(F.col("n") * share)).alias("held_out"))


def ranking_metrics(rows: DataFrame, truth: str, score: str, ks: tuple[int, ...] = (10, 20), relevant: int = 50) -> DataFrame:
    """(leader, k, precision, recall, ndcg): relevant are the first `relevant` items by truth; gains are binary."""
    w = W.partitionBy("leader")
    r = rows.withColumn("t", F.row_number().over(w.orderBy(F.desc(truth), "item"))).withColumn("p", F.row_number().over(w.orderBy(F.desc(score), "item")))
    r = r.withColumn("hit", (F.col("t") <= relevant).cast("int"))
    n = r.groupBy("leader").agg(F.sum("hit").alias("n_rel"))
    each = r.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("p <= k").groupBy("leader", "k").agg(F.sum("hit").alias("h"), F.sum(F.col("hit") / F.log2(F.col("p") + 1.0)).alias("dcg")).join(n, "leader")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return each.select("leader", "k", F.round(F.col("h") / F.col("k"), 6).alias("precision"), F.round(F.col("h") / F.col("n_rel"), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def errors(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(rmse, mae, r2)."""
    e = F.col(truth) - F.col(guess)
    m = rows.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("v"))
    return m.select(F.round(F.sqrt("mse"), 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round(1 - F.col("mse") / F.col("v"), 6).alias("r2"))


def item_vectors(lines: DataFrame, size: int = 128, window: int = 10, least: int = 5, epochs: int = 10, seed: int = 42, sample: float = SUBSAMPLE) -> DataFrame:
    """(item, vec) by skip-gram with negative sampling over baskets; an item stands up to four times, by its quantity."""
    words = lines.withColumn("w", F.expr("array_repeat(item, CAST(least(greatest(qty, 1), 4) AS INT))"))
    sentences = words.groupBy(F.col("basket_id").alias("sentence")).agg(F.flatten(F.sort_array(F.collect_list("w"))).alias("words"))
    return skip_gram(sentences, size, window, least, epochs, seed, sample)


def rate_model(rows: DataFrame, split: DataFrame, columns: list[str], rounds: int = 500, seed: int = 42):
    """(model, predictions of the held-out groups) of boosted trees on label; rounds end when the held-out error no longer falls.

    Rows are dealt by leader and item, as stored bytes and leaders would make few tasks of many; split has a row for each leader.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    n = rows.count()
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n >> TASK), n >> LARGE_TASK)
    dealt = rows.select("leader", "item", "label", *columns).join(F.broadcast(split), "leader").repartition(parts, "leader", "item").sortWithinPartitions("leader", "item")
    x = VectorAssembler(inputCols=columns, outputCol="x").transform(dealt)
    model = GBTRegressor(featuresCol="x", labelCol="label", maxDepth=6, stepSize=0.05, subsamplingRate=0.8, maxIter=rounds, seed=seed, validationIndicatorCol="held_out", validationTol=0.001).fit(x)
    return model, model.transform(x.where("held_out")).select("leader", "item", "label", "prediction", *columns)


def reduced(vectors: DataFrame, variance: float = 0.95) -> DataFrame:
    """(item, r): normalised vectors as the fewest principal components that hold `variance`, a stored table."""
    from pyspark.ml.feature import PCA, Normalizer, VectorSlicer
    from pyspark.ml.functions import array_to_vector

    x = Normalizer(inputCol="v", outputCol="n").transform(vectors.select("item", array_to_vector("vec").alias("v")))
    size = len(x.select("v").first()["v"])
    pca = PCA(k=size, inputCol="n", outputCol="all").fit(x)
    held, keep = 0.0, 0
    for share in pca.explainedVariance:
        held, keep = held + share, keep + 1
        if held >= variance:
            break
    return stored(VectorSlicer(inputCol="all", outputCol="r", indices=list(range(keep))).transform(pca.transform(x)).select("item", "r"), "components")


def silhouette(rows: DataFrame) -> float:
    """Mean silhouette (squared Euclidean) of (r, group) over all rows in a group; 0 with fewer than two groups."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    real = rows.where(F.col("group") != NOISE)
    if real.select("group").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(featuresCol="r", predictionCol="group").evaluate(real.select("r", F.col("group").cast("double").alias("group")))


def clusterings(vectors: DataFrame, ks: tuple[int, ...] = KS, variance: float = 0.95, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(item, group, method) of the clustering that is kept, and (method, clusters, silhouette, mean_size, noise, chosen) of all.

    Clusters by density are sought in a layout of PLACES coordinates, k-means groups in principal components. The first are kept if their silhouette and number reach the floors, else the k-means of best silhouette.
    A k that is not under the number of vectors is left out; if all are, one group holds all.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    y = reduced(vectors, variance)
    n = y.count()
    z = laid_out(vectors, PLACES, seed=seed).withColumnRenamed("place", "vec")
    tried = {"density": z.select("item", array_to_vector("vec").alias("r")).join(dense_clusters(z).withColumnRenamed("cluster", "group"), "item")}
    for k in ks:
        if k < n:
            tried[f"kmeans_{k}"] = KMeans(k=k, seed=seed, featuresCol="r", predictionCol="group").fit(y).transform(y)
    if len(tried) == 1:
        tried["one"] = y.withColumn("group", F.lit(0))
    told = {}
    for name, rows in tried.items():
        counts = rows.where(F.col("group") != NOISE).agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups")).first()
        told[name] = (counts.groups, round(silhouette(rows), 4), round(counts.n / counts.groups, 1) if counts.groups else 0.0, n - counts.n)
    groups, score, *_ = told["density"]
    best = "density" if score >= LEAST_SILHOUETTE and groups >= LEAST_GROUPS else max((m for m in told if m != "density"), key=lambda m: told[m][1])
    report = vectors.sparkSession.createDataFrame([(m, *v, m == best) for m, v in told.items()], "method string, clusters long, silhouette double, mean_size double, noise long, chosen boolean")
    return tried[best].select("item", F.col("group").cast("long").alias("group"), F.lit(best).alias("method")), report


def clustered(vectors: DataFrame, ks: tuple[int, ...] = KS, variance: float = 0.95, seed: int = 42) -> DataFrame:
    """(item, group, method): see clusterings."""
    return clusterings(vectors, ks, variance, seed)[0]


def described(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, median, std, least, most, q1, q3) of a value: sample deviation, linear quantiles, 6 places."""
    r = lambda c, name: F.round(c, 6).alias(name)
    sums = rows.groupBy(key).agg(F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.stddev_samp(value), "std"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = quantiles(rows, [key], value, [0.5, 0.25, 0.75]).select(F.col(key).alias("same"), *[r(F.get("quantiles", F.lit(i)), n) for i, n in enumerate(("median", "q1", "q3"))])
    return sums.join(q, F.col(key).eqNullSafe(F.col("same")), "left").select(key, "n", "mean", "median", "std", "least", "most", "q1", "q3")


def empty_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, empty): how many values of each column are null or not a number."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c))
    counts = rows.agg(*[bad(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("empty")) for c in columns])).alias("x")).select("x.feature", "x.empty")


def importances(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance) of a tree model, the largest first."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def error_scales(guess: DataFrame) -> DataFrame:
    """(scale, rmse, mae, r2) of predictions of a log label, on the log scale and on the raw one."""
    raw = guess.select(F.expm1("label").alias("label"), F.expm1("prediction").alias("prediction"))
    return errors(guess, "label", "prediction").withColumn("scale", F.lit("log")).unionByName(errors(raw, "label", "prediction").withColumn("scale", F.lit("raw")))


def errors_by_tercile(guess: DataFrame, by: str) -> DataFrame:
    """(tercile, n, mae): the error where a feature is in its lowest third, between, and in its highest (percentiles 33 and 66)."""
    cut = quantiles(guess, [], by, [0.33, 0.66]).select(F.get("quantiles", F.lit(0)).alias("a"), F.get("quantiles", F.lit(1)).alias("b"))
    third = F.when(F.col(by) <= F.col("a"), "low").when(F.col(by) <= F.col("b"), "middle").otherwise("high")
    return guess.crossJoin(F.broadcast(cut)).groupBy(third.alias("tercile")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("label") - F.col("prediction"))), 6).alias("mae"))
