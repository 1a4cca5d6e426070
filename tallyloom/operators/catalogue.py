"""Catalogue queries, merges of new data into old, and data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .advisor import shortened
from .grams import NameIndex


def best_printings(printings: DataFrame) -> DataFrame:
    """(item, best, best_price, first, cheapest, n): the dearest printing (null prices last), the first one, and the least positive price."""
    dear = F.min_by("printing", F.struct(F.coalesce(-F.col("price"), F.lit(float("inf"))), "printing"))
    return printings.groupBy("item").agg(dear.alias("best"), F.max("price").alias("best_price"), F.min("printing").alias("first"), F.min(F.when(F.col("price") > 0, F.col("price"))).alias("cheapest"), F.count("*").alias("n"))


def search(items: DataFrame, printings: DataFrame, pattern: str, k: int) -> DataFrame:
    """Items whose name is like the pattern, whatever the case, with their printings; by cost (null last), name, item."""
    return with_printings(items.where(F.col("name").ilike(pattern)), printings, k)


def indexed_search(index: NameIndex, items: DataFrame, printings: DataFrame, text: str, k: int) -> DataFrame:
    """As search, for names that hold a text, found by the index of their grams."""
    return with_printings(items.join(index.containing(text).select("item"), "item", "left_semi"), printings, k)


def with_printings(items: DataFrame, printings: DataFrame, k: int) -> DataFrame:
    """The first k items by cost (null last), name, item, with their printings."""
    order = [F.asc_nulls_last("cost"), F.asc("name"), F.asc("item")]
    found = items.select("item", "name", "cost").orderBy(*order).limit(k)
    return found.join(best_printings(printings.join(F.broadcast(found.select("item")), "item", "left_semi")), "item", "left")  # k rows at most


def autocomplete(branches: list[DataFrame], k: int) -> DataFrame:
    """(name): the names of the branches in turn, each limited first, the first of equals kept. Branches have a column name."""
    parts = [b.select("name").distinct().orderBy("name").limit(k).withColumn("b", F.lit(i)) for i, b in enumerate(branches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.min("b").alias("b")).orderBy("b", "name").limit(k).select("name")


def least_prices(printings: DataFrame, currency: str) -> DataFrame:
    return printings.where((F.col("price") > 0) & (F.col("currency") == currency)).groupBy("item").agg(F.min("price").alias("price"))


def latest_prices(printings: DataFrame) -> DataFrame:
    """(item, day, price): the price of the last day, the dearest of it."""
    return printings.groupBy("item").agg(F.max(F.struct("day", "price")).alias("p")).select("item", "p.day", "p.price")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with equal keys; of several new rows of a key the last by `order` counts."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("_r = 1").drop("_r")
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replaced_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """old without the children of the parents in new, and the children in new."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def flagged(items: DataFrame, names: DataFrame, key: Column) -> DataFrame:
    """items with flag: their name is in names exactly, or else by normalised key."""
    exact = names.select(F.col("name")).distinct().withColumn("e", F.lit(True))
    loose = names.select(key.alias("k")).distinct().withColumn("l", F.lit(True))
    return items.withColumn("k", key).join(exact, "name", "left").join(loose, "k", "left").withColumn("flag", F.coalesce("e", "l", F.lit(False))).drop("k", "e", "l")


def moved(deck: DataFrame, changes: DataFrame) -> DataFrame:
    """(leader, item, qty) after changes (leader, item, delta); items without copies left go."""
    both = deck.select("leader", "item", "qty").unionByName(changes.select("leader", "item", F.col("delta").alias("qty")))
    return both.groupBy("leader", "item").agg(F.sum("qty").alias("qty")).where("qty > 0")


def checked(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, ok): row counts, empty ones failing."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", (F.col("rows") > 0).alias("ok")) for n, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share_of(rows: DataFrame, what: str, holds: Column) -> DataFrame:
    """(name, rows, holding, percent, ok): how many rows hold something; none of them fails."""
    m = rows.agg(F.count("*").alias("rows"), F.count_if(holds).alias("holding"))
    percent = F.round((100 * F.col("holding") / F.when(F.col("rows") > 0, F.col("rows"))).cast("decimal(20,8)"), 1).cast("double")
    return m.select(F.lit(what).alias("name"), "rows", "holding", F.coalesce(percent, F.lit(0.0)).alias("percent"), (F.col("holding") > 0).alias("ok"))


def covered(items: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(items, covered, bare): how many items have a row in parts."""
    have = items.select(key).distinct().join(parts.select(key).where(F.col(key).isNotNull()).distinct().withColumn("y", F.lit(1)), key, "left")
    return have.agg(F.count("*").alias("items"), F.count("y").alias("covered")).select("items", "covered", (F.col("items") - F.col("covered")).alias("bare"))


def priced(printings: DataFrame) -> DataFrame:
    """(currency, printings): distinct printings of an item with a price in each currency."""
    return printings.where(F.col("price").isNotNull()).groupBy("currency").agg(F.count_distinct("item", "printing").alias("printings"))


def last_run(runs: DataFrame, success: str) -> DataFrame:
    """(run, status, ok) of the last of runs (run, status); no row fails a check by being absent."""
    return runs.agg(F.max_by(F.struct("run", "status"), "run").alias("x")).select("x.run", "x.status", F.coalesce(F.col("x.status") == success, F.lit(False)).alias("ok"))


def since_last(rows: DataFrame, key: str, time: str) -> DataFrame:
    """(key, last, seconds): the last time of each key, and the seconds from it to the last of all; times that don't parse are null and count nowhere."""
    at = F.col(time).try_cast("timestamp")
    each = rows.groupBy(key).agg(F.max(at).alias("last"))
    now = rows.agg(F.max(at).alias("now"))  # one row
    return each.join(F.broadcast(now), F.lit(True)).select(key, F.date_format("last", "yyyy-MM-dd").alias("last"), (F.unix_timestamp("now") - F.unix_timestamp("last")).alias("seconds"))


def references(items: DataFrame, names: list[str], prices: DataFrame) -> DataFrame:
    """(name, item, day, price, ok): each reference name with the smallest item of that name and its latest price; absent ones fail."""
    spark = items.sparkSession
    want = spark.createDataFrame([(n,) for n in names], "name string")
    found = items.groupBy("name").agg(F.min("item").alias("item"))
    return want.join(found, "name", "left").join(latest_prices(prices), "item", "left").select("name", "item", "day", "price", F.col("item").isNotNull().alias("ok"))


def tag_inventory(items: DataFrame, tags: DataFrame, k: int = 20) -> DataFrame:
    """(rank, tag, items, coverage): the k commonest tags, and the share of all items that have any tag."""
    n = items.agg(F.count_distinct("item").alias("n"))
    with_tag = tags.agg(F.count_distinct("item").alias("t"))
    share = F.round((F.col("t") / F.when(F.col("n") > 0, F.col("n"))).cast("decimal(20,8)"), 4).cast("double")
    top = tags.groupBy("tag").agg(F.count_distinct("item").alias("items")).orderBy(F.desc("items"), "tag").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("items"), "tag"))).crossJoin(F.broadcast(n.crossJoin(with_tag))).select("rank", "tag", "items", share.alias("coverage"))


def searched(items: DataFrame, printings: DataFrame, pattern: str, k: int) -> DataFrame:
    """(item, name, cost, image, price): as the search, with the printing whose picture is shown: the dearest, else the first; by rows of all days."""
    order = [F.asc_nulls_last("cost"), F.asc("name"), F.asc("item")]
    found = items.where(F.col("name").ilike(pattern)).select("item", "name", "cost").orderBy(*order).limit(k)
    own = printings.join(F.broadcast(found.select("item")), "item", "left_semi")
    dear = own.where("price IS NOT NULL").groupBy("item").agg(F.min_by("printing", F.struct(-F.col("price"), "printing")).alias("dear"))
    first = own.groupBy("item").agg(F.min("printing").alias("first"))
    least = own.where("price > 0").groupBy("item").agg(F.min("price").alias("price"))
    return found.join(dear, "item", "left").join(first, "item", "left").join(least, "item", "left").select("item", "name", "cost", F.coalesce("dear", "first").alias("image"), "price")


def search_printings(items: DataFrame, editions: DataFrame, prices: DataFrame, pattern: str, currency: str, k: int) -> DataFrame:
    """(item, name, cost, text, image, uri, price) of items (item, name, cost, text) like the pattern: the dearest printing's picture, else the first's; the least price.

    editions: (edition, item, image, uri); prices: (edition, currency, price) of all days. Four left joins: the dearest
    printing, the first, that one's own row, and the least price.
    """
    order = [F.asc_nulls_last("cost"), F.asc("name"), F.asc("item")]
    found = items.where(F.col("name").ilike(pattern)).orderBy(*order).limit(k).select("item", "name", "cost", shortened(F.col("text")).alias("text"))
    own = editions.join(F.broadcast(found.select("item")), "item", "left_semi")  # k items at most
    priced = own.join(prices.where((F.col("currency") == currency) & (F.col("price") > 0)).select("edition", "price"), "edition")
    dear = priced.groupBy("item").agg(F.min_by(F.struct("image", "uri"), F.struct(-F.col("price"), "edition")).alias("dear"))
    first = own.groupBy("item").agg(F.min("edition").alias("edition"))
    fallback = own.select("edition", F.struct("image", "uri").alias("other"))
    least = priced.groupBy("item").agg(F.min("price").alias("price"))
    all_ = found.join(dear, "item", "left").join(first, "item", "left").join(fallback, "edition", "left").join(least, "item", "left")
    return all_.select("item", "name", "cost", "text", F.coalesce("dear.image", "other.image").alias("image"), F.coalesce("dear.uri", "other.uri").alias("uri"), "price")


def translated_autocomplete(items: DataFrame, editions: DataFrame, start: str, k: int) -> DataFrame:
    """(name): names that start with a text, then names of items one of whose printed names does; each by cost (null last), name."""
    like = lambda c: F.lower(c).startswith(start.lower())
    order = [F.asc_nulls_last("cost"), F.asc("name")]
    part = lambda rows, b: rows.groupBy("name").agg(F.min("cost").alias("cost")).orderBy(*order).limit(k).withColumn("b", F.lit(b))
    foreign = editions.where(F.col("printed_name").isNotNull() & like(F.col("printed_name"))).select("item").distinct()
    both = part(items.where(like(F.col("name"))), 0).unionByName(part(items.join(foreign, "item", "left_semi"), 1))
    return both.groupBy("name").agg(F.min("b").alias("b"), F.min("cost").alias("cost")).orderBy("b", *order).limit(k).select("name")


def price_by_name(items: DataFrame, editions: DataFrame, prices: DataFrame, currency: str) -> DataFrame:
    """(name, price): the least positive price over all printings of the items of a name, whatever its case."""
    rows = prices.where((F.col("currency") == currency) & (F.col("price") > 0)).join(editions.select("edition", "item"), "edition").join(items.select("item", F.lower("name").alias("name")), "item")
    return rows.groupBy("name").agg(F.min("price").alias("price"))


def image_by_name(items: DataFrame, editions: DataFrame, lang: str) -> DataFrame:
    """(name, image): the picture of the first printing in a language that has one, of the items of a name."""
    rows = editions.where((F.col("lang") == lang) & F.col("image").isNotNull()).join(items.select("item", F.lower("name").alias("name")), "item")
    return rows.groupBy("name").agg(F.min_by("image", "edition").alias("image"))


def recently_changed(files: DataFrame, since: DataFrame) -> DataFrame:
    """(name, sync): whether a file (name, changed) is newer than its last sync (name, synced); files without one are."""
    j = files.join(since, "name", "left")
    return j.select("name", (F.col("synced").isNull() | (F.col("changed") > F.col("synced"))).alias("sync"))


def configured(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Deck entries (deck_id, url, leader, name) after decks were added or refreshed, by deck_id, and removed (deck_id)."""
    return upserted(old, added, ["deck_id"], F.struct("name", "url")).join(removed.select("deck_id"), "deck_id", "left_anti").select(old.columns)
