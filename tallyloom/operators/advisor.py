"""Collection advice: what to play, move, cut and how decks are composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .grams import built
from .ranks import ranked

#: Leaders of a row of rates.
SLOTS = 32


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in that order, with their rank. Rows are cut before they meet in one task."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def available(collection: DataFrame, decks: DataFrame, opened: DataFrame) -> DataFrame:
    """(item, source): items of the collection with more copies than decks that use them, then unused items of opened sets."""
    used = decks.groupBy("item").agg(F.count_distinct("leader").alias("used"))
    own = collection.join(used, "item", "left").where(F.col("qty") > F.coalesce("used", F.lit(0))).select("item", F.lit("collection").alias("source"))
    fresh = opened.join(own, "item", "left_anti").join(used, "item", "left_anti").select("item", F.lit("opened").alias("source"))
    return own.unionByName(fresh)


def best_leader(candidates: DataFrame, rates: DataFrame, decks: DataFrame) -> DataFrame:
    """(item, source, leader, rate): the leader with the best rate whose deck lacks the item; ties by leader."""
    j = candidates.join(rates.select("leader", "item", "rate"), "item").join(decks.select("leader", "item"), ["leader", "item"], "left_anti")
    r = F.row_number().over(W.partitionBy("item").orderBy(F.desc("rate"), "leader"))
    return j.withColumn("r", r).where("r = 1").select("item", "source", "leader", "rate")


def suggestions(candidates: DataFrame, rates: DataFrame, decks: DataFrame, k: int = 40) -> DataFrame:
    return top(best_leader(candidates, rates, decks), k, F.desc("rate"), F.asc("item")).select("rank", "item", "source", "leader", "rate")


def transfers(decks: DataFrame, rates: DataFrame, k: int = 30) -> DataFrame:
    """(rank, item, from_leader, to_leader, from_rate, to_rate, gain): the best move of each item to a deck that lacks it, by gain."""
    a = decks.select(F.col("leader").alias("from_leader"), "item").join(rates.select(F.col("leader").alias("from_leader"), "item", F.col("rate").alias("from_rate")), ["from_leader", "item"])
    b = rates.select(F.col("leader").alias("to_leader"), "item", F.col("rate").alias("to_rate"))
    j = a.join(b, "item").where("from_leader <> to_leader AND to_rate > from_rate").join(decks.select(F.col("leader").alias("to_leader"), "item"), ["to_leader", "item"], "left_anti")
    j = j.withColumn("gain", F.round(F.col("to_rate") - F.col("from_rate"), 4))
    r = F.row_number().over(W.partitionBy("item").orderBy(F.desc("gain"), "from_leader", "to_leader"))
    return top(j.withColumn("r", r).where("r = 1"), k, F.desc("gain"), F.asc("item")).select("rank", "item", "from_leader", "to_leader", "from_rate", "to_rate", "gain")


def cuts(decks: DataFrame, rates: DataFrame, items: DataFrame, baskets: DataFrame, basic: str) -> DataFrame:
    """(leader, rank, item, rate, n, total): deck items by rising rate; an absent item has 0 and the leader's total."""
    total = baskets.groupBy("leader").agg(F.count("*").alias("total"))
    j = decks.select("leader", "item").join(items.where(F.col("kind") != basic).select("item"), "item").join(rates.select("leader", "item", "rate", "n"), ["leader", "item"], "left").join(total, "leader")
    j = j.select("leader", "item", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("n", F.lit(0)).alias("n"), "total")
    return j.withColumn("rank", F.row_number().over(W.partitionBy("leader").orderBy("rate", "item")))


def composition(decks: DataFrame, lines: DataFrame, items: DataFrame, baskets: DataFrame, basic: str) -> DataFrame:
    """(leader, kind, own, corpus_mean): copies of each kind in the deck, and the mean over all of the leader's baskets."""
    kinds = items.select("item", "kind")
    own = decks.join(kinds, "item").groupBy("leader", "kind").agg(F.sum("qty").alias("own"))
    total = baskets.groupBy("leader").agg(F.count("*").alias("total"))
    mean = lines.join(kinds, "item").groupBy("leader", "kind").agg(F.sum("qty").alias("s")).join(total, "leader").select("leader", "kind", F.round(F.col("s") / F.col("total"), 4).alias("corpus_mean"))
    return mean.join(own, ["leader", "kind"], "full").select("leader", "kind", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("corpus_mean", F.lit(0.0)).alias("corpus_mean"))


def composition_by_type(decks: DataFrame, lines: DataFrame, baskets: DataFrame, named: DataFrame, types: DataFrame, lands: DataFrame, land: str) -> DataFrame:
    """(leader, type, own, corpus_mean, mean_cost): copies of each type in the deck, on the mean of the leader's baskets, and the deck's mean cost without lands.

    named: (item, name); types: (name, type, cost) of known names; lands: (name) of cards with a face that is a land, which count
    as one whatever their type. Items of unknown type count nowhere.
    """
    over = lands.select("name").distinct().withColumn("is_land", F.lit(True))
    known = named.join(types, "name", "left").join(over, "name", "left")
    typed = known.select("item", F.when(F.col("is_land"), F.lit(land)).otherwise(F.col("type")).alias("type"), F.when(F.col("is_land").isNull() & (F.col("type") != land), F.col("cost")).alias("cost")).where("type IS NOT NULL")
    own = decks.join(typed, "item").groupBy("leader", "type").agg(F.sum("qty").alias("own"))
    total = baskets.groupBy("leader").agg(F.count("*").alias("total"))
    mean = lines.join(typed, "item").groupBy("leader", "type").agg(F.sum("qty").alias("s")).join(total, "leader").select("leader", "type", F.round((F.col("s") / F.col("total")).cast("decimal(20,8)"), 1).cast("double").alias("corpus_mean"))
    costs = mean_cost(decks, typed.where("cost IS NOT NULL").select("item", "cost", F.lit("").alias("kind")), land)
    both = mean.join(own, ["leader", "type"], "full").join(costs, "leader", "left")
    return both.select("leader", "type", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("corpus_mean", F.lit(0.0)).alias("corpus_mean"), "mean_cost")


def mean_cost(decks: DataFrame, items: DataFrame, basic: str) -> DataFrame:
    """(leader, mean_cost): weighted by copies, without basics."""
    j = decks.join(items.where(F.col("kind") != basic), "item")
    return j.groupBy("leader").agg(F.round((F.sum(F.col("cost") * F.col("qty")) / F.sum("qty")).cast("decimal(20,8)"), 2).cast("double").alias("mean_cost"))


def leader_suggestions(rates: DataFrame, decks: DataFrame, k: int = 3) -> DataFrame:
    """(item, rank, leader, rate): the k leaders with the best rate whose deck lacks the item; rates to two places."""
    j = rates.select("item", "leader", "rate").join(decks.select("leader", "item"), ["leader", "item"], "left_anti")
    j = j.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("rate"), "leader"))).where(F.col("rank") <= k)
    return j.select("item", "leader", F.round(F.col("rate").cast("decimal(12,4)"), 2).cast("double").alias("rate"), "rank")


def detected_leader(cards: DataFrame, rates: DataFrame) -> DataFrame:
    """(basket_id, leader, score, matched): the leader with the best mean rate over the basket's known items, then most matches.

    Rates lie in rows of SLOTS leaders an item, so that a basket's item meets one row for all of these.
    """
    leaders = ranked(rates.select("leader").distinct(), ["leader"]).select("leader", F.floor((F.col("rank") - 1) / SLOTS).alias("row"), ((F.col("rank") - 1) % SLOTS).alias("slot"))
    slots = [f"s{i}" for i in range(SLOTS)]
    # whole numbers of ten-thousandths, so that sums have no last bit to differ in
    rate = F.round(F.col("rate") * 10_000).cast("int")
    wide = rates.join(leaders, "leader").groupBy("item", "row").agg(*[F.max(F.when(F.col("slot") == i, rate)).alias(c) for i, c in enumerate(slots)])
    # the lines of a basket meet before they are added up: a sum and a count of each slot would be wider than its rates in one array
    met = cards.select("basket_id", "item").join(wide.select("item", "row", F.array(*slots).alias("rates")), "item").select("basket_id", "row", "rates").repartition("basket_id")
    sums = met.groupBy("basket_id", "row").agg(*[F.sum(F.get("rates", F.lit(i))).alias(c) for i, c in enumerate(slots)], *[F.count(F.get("rates", F.lit(i))).alias(f"n{c}") for i, c in enumerate(slots)])
    score = lambda c: F.round((F.col(c) / 10_000 / F.col(f"n{c}")).cast("decimal(20,8)"), 2).cast("double")
    best = F.array_max(F.array(*[F.when(F.col(f"n{c}") > 0, F.struct(score(c).alias("score"), F.col(f"n{c}").alias("matched"), F.lit(-i).alias("slot"))) for i, c in enumerate(slots)]))
    rows = sums.select("basket_id", F.struct(best["score"].alias("score"), best["matched"].alias("matched"), (-F.col("row")).alias("row"), best["slot"].alias("slot")).alias("x")).groupBy("basket_id").agg(F.max("x").alias("x"))
    named = rows.select("basket_id", "x.score", "x.matched", (-F.col("x.row")).alias("row"), (-F.col("x.slot")).cast("long").alias("slot")).join(leaders, ["row", "slot"])
    return named.select("basket_id", "leader", "score", "matched")


def not_found(cards: DataFrame, rates: DataFrame) -> DataFrame:
    return cards.select("item").distinct().join(rates.select("item"), "item", "left_anti")


def item_source(items: DataFrame, decks: DataFrame, collection: DataFrame, opened: DataFrame) -> DataFrame:
    """(item, source, decks): in_deck, collection, opened_sets or null, the first that applies; all decks are listed."""
    d = decks.groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("leader")), ",").alias("decks"))
    j = items.select("item").join(d, "item", "left").join(collection.select("item", F.lit(True).alias("c")), "item", "left").join(opened.select("item", F.lit(True).alias("o")), "item", "left")
    return j.select("item", F.when(F.col("decks").isNotNull(), "in_deck").when(F.col("c"), "collection").when(F.col("o"), "opened_sets").alias("source"), "decks")


def rate_of(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """(leader, item, rate, n, total) of pairs (leader, item): rate to one place; null where the item was never found with the leader."""
    one = F.round(F.col("rate").cast("decimal(12,4)"), 1).cast("double").alias("rate")
    return pairs.select("leader", "item").join(rates.select("leader", "item", one, "n", "total"), ["leader", "item"], "left").select("leader", "item", "rate", "n", "total")


def decks_with(decks: DataFrame) -> DataFrame:
    """(item, decks): the leaders whose decks hold the item, in order, comma-joined."""
    return decks.groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("leader")), ",").alias("decks"))


def deck_list(configured: DataFrame, local: DataFrame) -> DataFrame:
    """(rank, name, source): configured decks and the local ones that no configured one covers, whatever the case of the name; by name."""
    key = F.lower("name")
    fresh = local.withColumn("k", key).join(configured.select(key.alias("k")).distinct(), "k", "left_anti").select("name", F.lit("local").alias("source"))
    both = configured.select("name", F.lit("configured").alias("source")).unionByName(fresh)
    return ranked(both.withColumn("low", key), ["low", "name", "source"]).select("rank", "name", "source")


def allowed_leaders(first: DataFrame, second: DataFrame, key) -> DataFrame:
    """(key, name): the names of two lists by key; the first list's spelling counts."""
    both = first.select("name", F.lit(0).alias("p")).unionByName(second.select("name", F.lit(1).alias("p"))).withColumn("key", key(F.col("name")))
    return both.groupBy("key").agg(F.min(F.struct("p", "name")).alias("x")).select("key", "x.name")


def partner_rates(names: DataFrame, totals: DataFrame) -> DataFrame:
    """(name, leader, total): which known leader (leader, total) stands for "A + B": the whole name or a part, the one with most baskets; the first of equals."""
    parts = F.concat(F.array(F.col("name")), F.transform(F.split("name", r"\+"), lambda x: F.trim(x)))
    each = names.select("name", F.posexplode(parts).alias("at", "leader")).join(totals, "leader")
    return each.groupBy("name").agg(F.max(F.struct("total", (-F.col("at")).alias("at"), "leader")).alias("x")).select("name", "x.leader", "x.total")


def matched_files(names: DataFrame, stems: DataFrame) -> DataFrame:
    """(name, stem, pass): the file of each name: its stem holds the name; else all words of four letters or more; else the first of these.

    Of several files of a pass the first by stem; an empty name is held by all. Names and words find their stems by an index of
    the stems' grams, each distinct one once; a stem that holds all words holds the first.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")
    words = F.filter(F.split("n", " +"), lambda w: F.length(w) >= 4)
    n = names.select("name", F.trim(plain("name")).alias("n")).distinct().withColumn("w", words).withColumn("first", F.get("w", 0))
    index = built(stems.select(F.col("stem").alias("item"), plain("stem").alias("name")))
    asked = n.select(F.col("n").alias("text")).unionByName(n.select(F.col("first").alias("text")))
    found = stored(index.holding(asked).select("text", F.col("item").alias("stem"), F.col("name").alias("f")), "stems-of-texts")
    first = lambda rows, keys: rows.groupBy(*keys).agg(F.min("stem").alias("stem"))
    whole = first(found.withColumnRenamed("text", "n"), ["n"]).withColumn("pass", F.lit(1))
    any_ = stems.agg(F.min("stem").alias("stem")).where("stem IS NOT NULL").select(F.lit("").alias("n"), "stem", F.lit(1).alias("pass"))
    all_words = n.where(F.size("w") > 0).select("w", "first").distinct().join(found.withColumnRenamed("text", "first"), "first").where(F.forall("w", lambda w: F.contains(F.col("f"), w)))
    ways = n.join(whole.unionByName(any_), "n").select("name", "pass", "stem")
    ways = ways.unionByName(n.join(first(all_words, ["w"]), "w").select("name", F.lit(2).alias("pass"), "stem"))
    ways = ways.unionByName(n.join(first(found.withColumnRenamed("text", "first"), ["first"]), "first").select("name", F.lit(3).alias("pass"), "stem"))
    return ways.groupBy("name").agg(F.min(F.struct("pass", "stem")).alias("x")).select("name", "x.stem", "x.pass")


def first_type(line, types: list[str]):
    """The first of the types, in their order, that the line holds, whatever the case; else null."""
    out = F
    for t in types:
        out = out.when(F.contains(F.lower(line), F.lit(t.lower())), F.lit(t))
    return out


def face_names(items: DataFrame) -> DataFrame:
    """(name, type, cost) of items (item, name, type, cost) with a type: the whole name, and what stands before // where no whole name says so; the smallest item of a name."""
    known = items.where("type IS NOT NULL")
    whole = known.select("name", F.lit(0).alias("p"), "item", "type", "cost")
    front = known.where(F.contains("name", F.lit("//"))).select(F.trim(F.get(F.split("name", "//"), 0)).alias("name"), F.lit(1).alias("p"), "item", "type", "cost")
    return whole.unionByName(front).groupBy("name").agg(F.min(F.struct("p", "item", "type", "cost")).alias("x")).select("name", "x.type", "x.cost")


def face_lands(items: DataFrame, faces: DataFrame, word: str) -> DataFrame:
    """(name): names, and their parts before //, of items with a face without cost whose line holds the word, or whose own line holds it after //."""
    land = faces.where(F.col("mana_cost").isNull() & F.col("line").ilike(f"%{word}%")).select("item")
    own = items.where(F.col("line").ilike(f"% // %{word}%")).select("item")
    names = items.join(land.unionByName(own), "item", "left_semi").select("name")
    return names.unionByName(names.where(F.contains("name", F.lit("//"))).select(F.trim(F.get(F.split("name", "//"), 0)).alias("name"))).distinct()


def shortened(text, length: int = 280):
    """The text, cut after so many characters with an ellipsis."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def labelled_rates(rates: DataFrame) -> DataFrame:
    """(leader, item, rate, label, badge): bands of the rate under 20, 40 and 60, and of the share over 0.7 and 0.5."""
    label = F.when(F.col("rate") < 20, "low").when(F.col("rate") < 40, "fair").when(F.col("rate") < 60, "good").otherwise("high")
    badge = F.when(F.col("rate") > 70, "strong").when(F.col("rate") > 50, "medium").otherwise("weak")
    return rates.select("leader", "item", "rate", label.alias("label"), badge.alias("badge"))


def deck_means_of_kind(lines: DataFrame, items: DataFrame, baskets: DataFrame) -> DataFrame:
    """(leader, kind, mean): copies of each kind in a basket, on the mean of all baskets of the leader, to one place."""
    per = lines.join(items.select("item", "kind"), "item").groupBy("leader", "basket_id", "kind").agg(F.sum("qty").alias("q"))
    n = baskets.groupBy("leader").agg(F.count("*").alias("decks"))
    return per.groupBy("leader", "kind").agg(F.sum("q").alias("s")).join(n, "leader").select("leader", "kind", F.round((F.col("s") / F.col("decks")).cast("decimal(20,8)"), 1).cast("double").alias("mean"))


def mean_cost_of_decks(lines: DataFrame, items: DataFrame, baskets: DataFrame, basic: str) -> DataFrame:
    """(leader, mean_cost): the mean of the baskets' rounded mean costs over all baskets, those without any cost included, to two places."""
    per = lines.join(items.where(F.col("kind") != basic).select("item", "cost"), "item").groupBy("leader", "basket_id").agg(F.round((F.sum(F.col("cost") * F.col("qty")) / F.sum("qty")).cast("decimal(20,8)"), 2).alias("c"))
    n = baskets.groupBy("leader").agg(F.count("*").alias("decks"))
    return per.groupBy("leader").agg(F.sum("c").alias("s")).join(n, "leader").select("leader", F.round((F.col("s") / F.col("decks")).cast("decimal(20,8)"), 2).cast("double").alias("mean_cost"))


def counters(collection: DataFrame, candidates: DataFrame, decks: DataFrame) -> DataFrame:
    """(name, n): items of the collection, those of it and of opened sets that are free, and leaders with a deck."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    free = candidates.groupBy("source").agg(F.count("*").alias("n"))
    names = collection.sparkSession.createDataFrame([("collection",), ("opened",)], "source string")
    free = names.join(free, "source", "left").select(F.concat(F.lit("free of "), "source").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return n(collection, "collection").unionByName(free).unionByName(n(decks.select("leader").distinct(), "leaders"))


def without_data(decks: DataFrame, rates: DataFrame) -> DataFrame:
    """(leader): leaders with a deck of whom no rates are known; their items cannot be moved."""
    return decks.select("leader").distinct().join(rates.select("leader").distinct(), "leader", "left_anti")
