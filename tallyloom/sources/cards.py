"""Readers of card objects and of the lists beside a corpus: bulk JSON, alias maps, set lists, deck folders, cluster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import popularity_key
from .arrays import array_objects
from .lists import collection, corpus, decoded, parsed_line

#: The fields of a card object that rows are made of.
CARD = """id string, oracle_id string, name string, mana_cost string, cmc double, type_line string, oracle_text string,
power string, toughness string, loyalty string, defense string, colors array<string>, color_identity array<string>, keywords array<string>,
legalities map<string,string>, image_uris map<string,string>, prices map<string,string>, `set` string, set_name string, lang string,
rarity string, released_at string, reserved boolean, digital boolean, game_changer boolean, collector_number string, set_type string,
card_faces array<struct<name:string,mana_cost:string,type_line:string,oracle_text:string,image_uris:map<string,string>>>"""
#: Price columns of a card object: (name, currency, kind).
PRICES = [("eur", "eur", "regular"), ("eur_foil", "eur", "foil"), ("usd", "usd", "regular"), ("usd_foil", "usd", "foil"), ("tix", "tix", "regular")]


def bulk_cards(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Card objects of JSON arrays (several tasks read one), or of JSON lines, and `at`, their order in the files. Objects that don't parse, or without id, go."""
    if multi_line:
        texts = array_objects(spark, path).select(F.struct("file", F.lit(0).cast("long").alias("block"), F.col("number").alias("i")).alias("at"), "value")
    else:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
        texts = spark.read.text(path).select(place.alias("at"), "value")
    return texts.select("at", F.from_json("value", CARD).alias("x")).select("at", "x.*").where("id IS NOT NULL")


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that stands last in the files (`at`)."""
    rest = [c for c in rows.columns if c not in (*keys, "at")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("x")).select(*keys, "x.*")


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).alias(c)


def card_rows(cards: DataFrame) -> DataFrame:
    """One row for each card (oracle_id, else id), of its last object: name, key, cost and line (its own, else its first face's), colours, legality, flags."""
    face = F.get("card_faces", 0)
    key = F.coalesce("oracle_id", "id")
    rows = cards.select(
        "at", key.alias("card"), "name", F.lower(F.trim("name")).alias("key"), F.coalesce("mana_cost", face["mana_cost"]).alias("mana_cost"), F.coalesce("cmc", F.lit(0.0)).alias("cost"),
        F.coalesce("type_line", face["type_line"]).alias("line"), F.coalesce("oracle_text", face["oracle_text"]).alias("text"), _text("power"), _text("toughness"), _text("loyalty"), _text("defense"),
        F.coalesce("colors", F.array().cast("array<string>")).alias("colours"), F.coalesce("color_identity", F.array().cast("array<string>")).alias("identity"), F.to_json("keywords").alias("keywords"),
        F.coalesce(F.try_element_at("legalities", F.lit("commander")) == "legal", F.lit(False)).alias("legal"), F.coalesce("reserved", F.lit(False)).alias("reserved"), F.coalesce("game_changer", F.lit(False)).alias("game_changer"),
    )
    return last_of(rows, ["card"])


def face_rows(cards: DataFrame) -> DataFrame:
    """(card, face, name, mana_cost, line, text, image) of the last object of each card with faces; an empty cost is null."""
    last = last_of(cards.where("card_faces IS NOT NULL").select("at", F.coalesce("oracle_id", "id").alias("card"), "card_faces"), ["card"])
    each = last.select("card", F.posexplode("card_faces").alias("face", "f"))
    return each.select("card", "face", "f.name", F.nullif("f.mana_cost", F.lit("")).alias("mana_cost"), F.col("f.type_line").alias("line"), F.col("f.oracle_text").alias("text"), F.try_element_at("f.image_uris", F.lit("normal")).alias("image"))


def printing_rows(cards: DataFrame) -> DataFrame:
    """(printing, card, set, number, lang, rarity, day, digital, image): the image is the card's, else its first face's; a bad date is null."""
    image = F.coalesce(F.try_element_at("image_uris", F.lit("normal")), F.try_element_at(F.get("card_faces", 0)["image_uris"], F.lit("normal")))
    rows = cards.select("at", F.col("id").alias("printing"), F.coalesce("oracle_id", "id").alias("card"), "set", F.col("collector_number").alias("number"), F.coalesce("lang", F.lit("en")).alias("lang"), "rarity", F.expr("try_cast(released_at AS date)").alias("day"), F.coalesce("digital", F.lit(False)).alias("digital"), image.alias("image"))
    return last_of(rows, ["printing"])


def price_rows(cards: DataFrame) -> DataFrame:
    """(printing, currency, kind, price) of the prices that parse."""
    each = F.array(*[F.struct(F.lit(c).alias("currency"), F.lit(k).alias("kind"), F.try_element_at("prices", F.lit(n)).alias("p")) for n, c, k in PRICES])
    rows = last_of(cards.select("at", F.col("id").alias("printing"), "prices"), ["printing"]).select("printing", F.explode(each).alias("x"))
    return rows.select("printing", "x.currency", "x.kind", F.col("x.p").try_cast("decimal(10,2)").alias("price")).where("price IS NOT NULL")


def set_rows(cards: DataFrame) -> DataFrame:
    """(set, name, kind, day): each set once, with the first day of its cards."""
    return cards.where("`set` IS NOT NULL").groupBy("set").agg(F.min("set_name").alias("name"), F.min("set_type").alias("kind"), F.min(F.expr("try_cast(released_at AS date)")).alias("day"))


def instant(text: Column) -> Column:
    """A time with offset or Z as a timestamp; what doesn't parse is null."""
    return text.try_cast("timestamp")


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a JSON object; keys that start with _ are comments."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "canonical"))
    return entries.where(~F.startswith("alias", F.lit("_")))


def opened_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set): a code on each line, lower case; blank lines and comments go."""
    code = F.lower(F.trim("value"))
    return spark.read.text(path).select(code.alias("set")).where((F.col("set") != "") & ~F.startswith("set", F.lit("#"))).distinct()


def deck_usage(spark: SparkSession, folder: str, key) -> DataFrame:
    """(item, decks): in how many list files of a folder each item stands."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    lines = raw.select("path", F.explode(F.split(decoded("content"), r"\r?\n")).alias("value"))
    name, _ = parsed_line(F.col("value"))
    return lines.select("path", key(name).alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count_distinct("path").alias("decks"))


def cluster_files(spark: SparkSession, folder: str) -> DataFrame:
    """(item, frequency, cluster) of all CSV files of a folder with a header."""
    return spark.read.option("header", True).schema("item string, frequency double, cluster int").csv(f"{folder}/*.csv")


def popularity_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(baskets, items) of a corpus for popularity: the leader stays among the items, basics too; names by the popularity key."""
    rows = corpus(spark, folder).withColumn("item", popularity_key(F.col("name")))
    named = rows.groupBy("file", "folder").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_leader"), F.col("item")))), " + ").alias("l"))
    baskets = named.select(F.col("file").alias("basket_id"), F.when(F.col("l") == "", F.regexp_replace("folder", "_", " ")).otherwise(F.col("l")).alias("leader"))
    return baskets, rows.select(F.col("file").alias("basket_id"), "item").distinct().join(baskets, "basket_id")


def collection_file(spark: SparkSession, path: str, key) -> DataFrame:
    """(item, qty) of a list file."""
    return collection(spark.read.text(path), key)
