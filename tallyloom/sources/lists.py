"""Readers and parsers of list files, delimited corpora and nested JSON; and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that are left out of statistics (fixed values).
BASIC_LANDS = ["Plains", "Island", "Swamp", "Mountain", "Forest", "Wastes", "Snow-Covered Plains", "Snow-Covered Island", "Snow-Covered Swamp", "Snow-Covered Mountain", "Snow-Covered Forest"]


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as UTF-8 (with or without a mark), else cp1252, else latin-1."""

    def one(b):
        for name in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue

    return raw.map(one)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file, folder, name, qty, is_leader) of all *.csv under folder, separated by ;. Blank names go; a missing quantity is 1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder)
    lines = raw.select(F.col("path").alias("file"), F.posexplode(F.split(decoded("content"), r"\r?\n")).alias("at", "line"))
    cells = lines.withColumn("c", F.transform(F.split("line", ";"), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))))
    head = cells.where("at = 0").select("file", F.col("c").alias("h"))
    value = lambda name: F.get("c", F.array_position("h", F.lit(name)).cast("int") - 1)
    rows = cells.where("at > 0").join(head, "file").select("file", F.element_at(F.split("file", "/"), -2).alias("folder"), value("Card Name").alias("name"), F.coalesce(value("Quantity").try_cast("int"), F.lit(1)).alias("qty"), F.coalesce(F.upper(value("Commander")) == "YES", F.lit(False)).alias("is_leader"))
    return rows.where(F.col("name").isNotNull() & (F.col("name") != ""))


def corpus_baskets(rows: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(baskets, items) of a corpus: leader by the alias table (alias, canonical), unmapped ones left out, an empty table leaving all as they are; folder if none is named."""
    named = rows.groupBy("file", "folder").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_leader"), F.col("name")))), " + ").alias("l"))
    b = named.select(F.col("file").alias("basket_id"), F.when(F.col("l") == "", F.regexp_replace("folder", "_", " ")).otherwise(F.col("l")).alias("leader"))
    if aliases is not None and not aliases.isEmpty():
        b = b.join(aliases.select(F.col("alias").alias("leader"), "canonical"), "leader").select("basket_id", F.col("canonical").alias("leader"))
    i = rows.where(~F.col("is_leader") & ~F.col("name").isin(BASIC_LANDS)).select(F.col("file").alias("basket_id"), F.col("name").alias("item")).distinct().join(b, "basket_id")
    return b, i


def parsed_line(line: Column) -> tuple[Column, Column]:
    """(name, qty) of a list line: comments give null; foil marks and (SET) numbers go; qty is the leading number, else 1."""
    t = F.trim(line)
    t = F.regexp_replace(F.regexp_replace(t, r"\*F\*", ""), r"\([A-Za-z0-9]+\)\s*[0-9A-Za-z★-]*\s*$", "")
    t = F.trim(t)
    name = F.trim(F.regexp_replace(t, r"^[0-9]+[xX]?\s+", ""))
    qty = F.coalesce(F.regexp_extract(t, r"^([0-9]+)[xX]?\s+", 1).try_cast("int"), F.lit(1))
    keep = (t != "") & ~t.startswith("#") & ~t.startswith("//")
    return F.when(keep, name), F.when(keep, qty)


def collection(lines: DataFrame, key) -> DataFrame:
    """(item, qty): lines (value) parsed, quantities summed by key."""
    name, qty = parsed_line(F.col("value"))
    return lines.select(name.alias("n"), qty.alias("qty")).where("n IS NOT NULL").groupBy(key(F.col("n")).alias("item")).agg(F.sum("qty").alias("qty"))


def sectioned_list(texts: DataFrame) -> DataFrame:
    """(file, name, qty, is_leader) of whole texts (file, text): sections end at blank lines; a last section of one line is the leader."""
    s = texts.select("file", F.filter(F.split(F.trim(F.regexp_replace("text", r"\r", "")), r"\n\s*\n"), lambda x: F.trim(x) != "").alias("s"))
    rows = s.select("file", F.size("s").alias("m"), F.posexplode("s").alias("i", "part")).select("file", "m", "i", F.filter(F.split("part", r"\n"), lambda x: F.trim(x) != "").alias("lines"))
    each = rows.select("file", ((F.col("m") >= 2) & (F.col("i") == F.col("m") - 1) & (F.size("lines") == 1)).alias("is_leader"), F.explode("lines").alias("line"))
    name, qty = parsed_line(F.col("line"))
    return each.select("file", name.alias("name"), qty.alias("qty"), "is_leader").where("name IS NOT NULL")


def frequency_index(rows: DataFrame) -> DataFrame:
    """(leader, item, rate, n) of text columns (at, leader, item, rate, n): rows that don't parse go, the last of a key counts."""
    t = rows.select("at", "leader", "item", F.col("rate").try_cast("double").alias("rate"), F.col("n").try_cast("long").alias("n")).dropna()
    r = F.row_number().over(W.partitionBy("leader", "item").orderBy(F.desc("at")))
    return t.withColumn("r", r).where("r = 1").select("leader", "item", "rate", "n")


def nested_decks(spark: SparkSession, path: str) -> DataFrame:
    """(deck, leader, item, qty) of JSON deck files {data: {name, boards: {board: {cards: {id: {quantity, card: {name}}}}}}}."""
    card = "struct<quantity:int,card:struct<name:string>>"
    schema = f"data struct<name:string,boards:map<string,struct<cards:map<string,{card}>>>>"
    d = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.col("data.name").alias("deck"), F.col("data.boards").alias("b"))
    names = F.array_sort(F.transform(F.map_values(F.col("b")["commanders"]["cards"]), lambda x: x["card"]["name"]))
    leader = F.coalesce(F.nullif(F.array_join(names, " + "), F.lit("")), F.col("deck"))
    main = F.map_values(F.map_filter("b", lambda k, _: k.isin("mainboard", "sideboard")))
    return d.select("deck", leader.alias("leader"), F.explode(F.flatten(F.transform(main, lambda x: F.map_values(x["cards"])))).alias("x")).select("deck", "leader", F.col("x.card.name").alias("item"), F.coalesce("x.quantity", F.lit(1)).alias("qty"))


def face_rows(cards: DataFrame) -> DataFrame:
    """(id, name, mana_cost, cmc, face, price_kind, price) of card objects: own values, else those of the first face; prices that don't parse go."""
    own = cards.select("id", "name", F.coalesce("mana_cost", F.get("card_faces", 0)["mana_cost"]).alias("mana_cost"), F.coalesce("cmc", F.lit(0.0)).alias("cmc"), F.size(F.coalesce("card_faces", F.array())).alias("faces"), F.explode_outer("prices").alias("price_kind", "p"))
    return own.withColumn("price", F.col("p").try_cast("decimal(10,2)")).drop("p")


def write_sections(additions: DataFrame, removals: DataFrame, path: str) -> None:
    """(section, rank, item, score, support, frequency) as CSV, one folder a section."""
    a = additions.select(F.lit("add").alias("section"), "rank", "item", "score", F.lit(None).cast("long").alias("support"), F.lit(None).cast("long").alias("frequency"))
    r = removals.select(F.lit("remove").alias("section"), "rank", "item", F.lit(None).cast("long").alias("score"), "support", "frequency")
    a.unionByName(r).write.mode("overwrite").partitionBy("section").option("header", True).csv(path)
