"""Hybrid scores, deck profiles, gaps, and the additions and cuts that follow from them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import as_vectors, cosine, weighted_means

#: Weights of TF-IDF, vector, cluster and tag in the hybrid score (fixed values).
TFIDF, VECTOR, CLUSTER, TAG = 0.40, 0.25, 0.20, 0.15


def exact(column: Column | str, places: int) -> Column:
    """A number of so many places as a decimal, so that weighted sums have no last bit to differ in."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal(18,{places})")


def _w(value: str) -> Column:
    return F.lit(Decimal(value))


def tag_scores(pairs: DataFrame, item_tags: DataFrame, given: DataFrame, weights: DataFrame) -> DataFrame:
    """(leader, item, tag_score): sum over tags and clusters of P(cluster | tag) * weight, by the number of all tags, at most 1."""
    t = item_tags.select("item", "tag")
    n = t.groupBy("item").agg(F.count("*").alias("tags"))
    # what a tag is worth to a leader, before any item
    worth = given.join(weights.select("leader", "cluster", "weight"), "cluster").groupBy("leader", "tag").agg(F.sum(F.col("p") * F.col("weight")).alias("s"))
    s = pairs.select("leader", "item").join(t, "item").join(worth, ["leader", "tag"]).groupBy("leader", "item").agg(F.sum("s").alias("s"))
    return s.join(n, "item").select("leader", "item", F.least(F.col("s") / F.col("tags"), F.lit(1.0)).alias("tag_score"))


def leader_vectors(profile: DataFrame, vectors: DataFrame) -> DataFrame:
    rows = profile.join(vectors, "item").select("leader", "vec", F.col("tfidf_norm").alias("w"))
    return as_vectors(weighted_means(rows, "leader"), "leader").withColumnRenamed("vec", "leader_vec")


def leader_cosine(vec: Column, leader_vec: Column) -> Column:
    """The cosine of an item to a leader; 0 where one has no vector."""
    return F.when(vec.isNotNull() & leader_vec.isNotNull(), cosine(vec, leader_vec)).otherwise(0.0)


def hybrid(pairs: DataFrame, profile: DataFrame, vectors: DataFrame, weights: DataFrame, scores: DataFrame, leaders: DataFrame) -> DataFrame:
    """(leader, item, cosine, hybrid, tfidf_norm, weight, tag_score) of pairs (leader, item); what is unknown counts 0."""
    j = pairs.select("leader", "item").join(profile.select("leader", "item", "tfidf_norm"), ["leader", "item"], "left").join(vectors, "item", "left").join(leaders, "leader", "left")
    j = j.withColumn("cosine", leader_cosine(F.col("vec"), F.col("leader_vec")))
    j = j.join(weights.select("leader", "cluster", "weight"), ["leader", "cluster"], "left").join(scores, ["leader", "item"], "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    h = TFIDF * z("tfidf_norm") + VECTOR * F.col("cosine") + CLUSTER * z("weight") + TAG * z("tag_score")
    return j.select("leader", "item", F.round("cosine", 6).alias("cosine"), F.round(F.least(h, F.lit(1.0)), 4).alias("hybrid"), z("tfidf_norm").alias("tfidf_norm"), z("weight").alias("weight"), F.round(z("tag_score"), 6).alias("tag_score"))


def deck_means(decks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, vec) of the deck's items with unit vectors, and (leader, mean) of each deck."""
    v = decks.select("leader", "item").join(vectors, "item").withColumn("n", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    unit = v.select("leader", F.transform("vec", lambda x: F.when(F.col("n") > 0, x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).otherwise(0.0)).alias("vec"))
    return unit, as_vectors(weighted_means(unit.withColumn("w", F.lit(1.0)), "leader"), "leader").withColumnRenamed("vec", "mean")


def deck_cosines(pairs: DataFrame, decks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(leader, item, deck_cosine) of pairs (leader, item) whose item has a vector: its cosine to the mean direction of the deck."""
    mean = deck_means(decks, vectors)[1]
    return pairs.select("leader", "item").join(vectors.select("item", "vec"), "item").join(mean, "leader").select("leader", "item", F.round(cosine(F.col("vec"), F.col("mean")), 6).alias("deck_cosine"))


def deck_profile(decks: DataFrame, vectors: DataFrame, leaders: DataFrame) -> DataFrame:
    """(leader, coherence, similarity): mean cosine of the deck's vectors to their mean direction and to the leader's vector."""
    unit, mean = deck_means(decks, vectors)
    j = unit.join(mean, "leader").join(leaders, "leader", "left")
    return j.groupBy("leader").agg(F.round(F.avg(cosine(F.col("vec"), F.col("mean"))), 6).alias("coherence"), F.round(F.coalesce(F.avg(cosine(F.col("vec"), F.col("leader_vec"))), F.lit(0.0)), 6).alias("similarity"))


def shares(decks: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """(leader, kind, n, share) of the deck's lines, repeated items included, by a column of kinds (item, kind)."""
    n = decks.groupBy("leader").agg(F.count("*").alias("lines"))
    return decks.select("leader", "item").join(kinds.select("item", kind), "item").groupBy("leader", kind).agg(F.count("*").alias("n")).join(n, "leader").select("leader", kind, "n", F.round(F.col("n") / F.col("lines"), 4).alias("share"))


def gaps(decks: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(leader, cluster, own, meta, delta): share of the deck and of the leader's profile in each cluster; absent is 0."""
    n = decks.groupBy("leader").agg(F.count("*").alias("n"))
    own = decks.join(vectors.select("item", "cluster"), "item").groupBy("leader", "cluster").agg(F.count("*").alias("m")).join(n, "leader").select("leader", "cluster", F.round(F.col("m") / F.col("n"), 6).alias("own"))
    j = own.join(weights.select("leader", "cluster", F.col("weight").alias("meta")), ["leader", "cluster"], "full")
    j = j.select("leader", "cluster", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("meta", F.lit(0.0)).alias("meta"))
    return j.withColumn("delta", F.round(F.col("own") - F.col("meta"), 6))


def gap_states(gap: DataFrame) -> DataFrame:
    """(leader, cluster, own, meta, delta, state, shown, missing): under and over by 0.02, shown beyond 0.015, missing where 0.05 or more of the profile is not there at all."""
    state = F.when(F.col("delta") < -0.02, "under").when(F.col("delta") > 0.02, "over").otherwise("even")
    return gap.select("leader", "cluster", "own", "meta", "delta", state.alias("state"), (F.abs("delta") > 0.015).alias("shown"), ((F.col("own") == 0) & (F.col("meta") > 0.05)).alias("missing"))


def compatible(item: Column, leader: Column) -> Column:
    """Whether all colours of the item are among the leader's; an item without any, or unknown, is."""
    return F.coalesce(F.size(F.array_except(item, leader)) == 0, F.lit(True))


def additions(hybrids: DataFrame, rates: DataFrame, gap: DataFrame, vectors: DataFrame, decks: DataFrame, item_colours: DataFrame, leader_colours: DataFrame, k: int = 30) -> DataFrame:
    """(leader, rank, item, score, bonus, synergy): hybrid, rate, gap and synergy of the leader's items that the deck lacks.

    Items with a colour that the leader lacks are left out, if the leader's colours are known.
    """
    under = gap.where("delta < -0.02").select("leader", "cluster", F.abs("delta").alias("d"))
    under = under.withColumn("bonus", F.round(F.col("d") / F.max("d").over(W.partitionBy("leader")), 6)).drop("d")
    pool = hybrids.join(decks.select("leader", "item"), ["leader", "item"], "left_anti").join(rates.select("leader", "item", "rate"), ["leader", "item"])
    pool = pool.join(item_colours.select("item", F.col("colours").alias("ic")), "item", "left").join(leader_colours.select("leader", F.col("colours").alias("lc")), "leader", "left")
    pool = pool.where((F.size(F.coalesce("lc", F.array().cast("array<int>"))) == 0) | compatible(F.col("ic"), F.col("lc")))
    j = pool.join(vectors.select("item", "cluster"), "item", "left").join(under, ["leader", "cluster"], "left").join(deck_cosines(pool, decks, vectors), ["leader", "item"], "left")
    bonus, synergy = F.coalesce("bonus", F.lit(0.0)), F.greatest(F.coalesce("deck_cosine", F.lit(0.0)), F.lit(0.0))
    rate = F.least(exact("rate", 4) * _w("0.01"), F.lit(Decimal(1)))
    s = _w("0.40") * exact("hybrid", 4) + _w("0.30") * rate + _w("0.20") * exact(bonus, 6) + _w("0.10") * exact(synergy, 6)
    j = j.select("leader", "item", F.round(s, 4).cast("double").alias("score"), bonus.alias("bonus"), synergy.alias("synergy"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


def cuts(hybrids: DataFrame, gap: DataFrame, vectors: DataFrame, decks: DataFrame, rates: DataFrame, protected: DataFrame, k: int = 30) -> DataFrame:
    """(leader, rank, item, score, reasons): deck items that fit least, less the protected ones (item); reasons: array of texts, by thresholds (fixed values)."""
    own = decks.select("leader", "item").join(protected.select("item"), "item", "left_anti")
    j = hybrids.join(own, ["leader", "item"]).join(vectors.select("item", "cluster"), "item", "left").join(gap.select("leader", "cluster", "meta"), ["leader", "cluster"], "left")
    j = j.join(deck_cosines(own, decks, vectors), ["leader", "item"], "left").join(rates.select("leader", "item", "rate"), ["leader", "item"], "left")
    meta, synergy, rate = F.coalesce("meta", F.lit(0.0)), F.greatest(F.coalesce("deck_cosine", F.lit(0.0)), F.lit(0.0)), F.coalesce("rate", F.lit(0.0))
    s = _w("0.40") * (1 - exact("hybrid", 4)) + _w("0.35") * (1 - F.least(5 * exact(meta, 6), F.lit(Decimal(1)))) + _w("0.25") * (1 - exact(synergy, 6))
    why = F.array_compact(
        F.array(
            F.when(rate == 0, "not played with this leader").when(rate < 5, "seldom played with this leader"),
            F.when(F.col("hybrid") < 0.08, "low hybrid score"),
            F.when(synergy < 0.3, "little synergy with the deck"),
            F.when(F.col("cluster").isNotNull() & (meta < 0.01), "cluster absent from the profile"),
        )
    )
    why = F.when(F.size(why) == 0, F.array(F.lit("less suited on the whole"))).otherwise(why)
    j = j.select("leader", "item", F.round(s, 4).cast("double").alias("score"), why.alias("reasons"))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


def replacements(out: DataFrame, into: DataFrame) -> DataFrame:
    """(leader, rank, cut, added, gain, reasons): the i-th cut, with its first two reasons, meets the i-th addition."""
    a = out.select("leader", "rank", F.col("item").alias("cut"), F.col("score").alias("c"), F.array_join(F.slice("reasons", 1, 2), " | ").alias("reasons"))
    b = into.select("leader", "rank", F.col("item").alias("added"), F.col("score").alias("s"))
    gain = (exact("s", 4) - (1 - exact("c", 4))) * 100
    return a.join(b, ["leader", "rank"]).select("leader", "rank", "cut", "added", F.round(gain, 1).cast("double").alias("gain"), "reasons")


def global_score(profile: DataFrame, gap: DataFrame) -> DataFrame:
    """(leader, distance, score)."""
    d = gap.groupBy("leader").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("d"))
    s = 0.40 * F.col("coherence") + 0.35 * F.col("similarity") + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("d"))
    return profile.join(d, "leader").select("leader", F.round("d", 6).alias("distance"), F.round(s, 4).alias("score"))
