"""Readers of card objects and lists, and writers, on small files."""

import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators import advisor, catalogue, ml, popularity
from tallyloom.sources import cards, writers

CARDS = [
    {"id": "p1", "oracle_id": "o1", "name": "Rock", "mana_cost": "{1}", "cmc": 1, "type_line": "Artifact", "colors": [], "color_identity": [], "keywords": ["Flash"], "legalities": {"commander": "legal"}, "image_uris": {"normal": "u1"}, "prices": {"eur": "1.50", "usd": "n/a", "tix": None}, "set": "aaa", "set_name": "First", "lang": "en", "rarity": "common", "released_at": "2020-01-02", "power": ""},
    {"id": "p2", "oracle_id": "o1", "name": "Rock", "mana_cost": "{1}", "cmc": 1, "type_line": "Artifact", "prices": {"eur_foil": "3.00"}, "set": "bbb", "set_name": "Second", "released_at": "bad"},
    {"id": "p3", "oracle_id": "o2", "name": "Day // Night", "type_line": "Instant // Land", "set": "aaa", "set_name": "First", "released_at": "2019-05-05", "legalities": {"commander": "banned"}, "card_faces": [{"name": "Day", "mana_cost": "{W}", "type_line": "Instant", "image_uris": {"normal": "u3"}}, {"name": "Night", "mana_cost": "", "type_line": "Land"}]},
    {"name": "no id"},
]


def test_card_objects(spark, tmp_path):
    (tmp_path / "bulk.json").write_text(json.dumps(CARDS))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, CARDS)))
    c = cards.bulk_cards(spark, str(tmp_path / "bulk.json"))
    assert c.count() == 3 == cards.bulk_cards(spark, str(tmp_path / "lines.json"), multi_line=False).count()
    rows = {r.card: r for r in cards.card_rows(c).collect()}
    assert set(rows) == {"o1", "o2"} and not rows["o1"].legal and not rows["o2"].legal and rows["o2"].mana_cost == "{W}" and rows["o1"].power is None
    faces = cards.face_rows(c)
    assert sorted((r.face, r.name, r.mana_cost) for r in faces.collect()) == [(0, "Day", "{W}"), (1, "Night", None)]
    assert {(r.printing, r.day, r.image) for r in cards.printing_rows(c).collect()} == {("p1", date(2020, 1, 2), "u1"), ("p2", None, None), ("p3", date(2019, 5, 5), "u3")}
    assert {tuple(r) for r in cards.price_rows(c).collect()} == {("p1", "eur", "regular", Decimal("1.50")), ("p2", "eur", "foil", Decimal("3.00"))}
    assert {(r.set, r.name, r.day) for r in cards.set_rows(c).collect()} == {("aaa", "First", date(2019, 5, 5)), ("bbb", "Second", None)}
    items = cards.card_rows(c).select(F.col("card").alias("item"), F.col("key").alias("name"), "line")
    lands = advisor.face_lands(items, faces.withColumnRenamed("card", "item"), "land")
    assert sorted(r.name for r in lands.collect()) == ["day", "day // night"]


def test_lists_beside_a_corpus(spark, tmp_path):
    (tmp_path / "aliases.json").write_text('{"_note": "x", "Bo": "Boss",\n "Al": "Alpha"}')
    assert {tuple(r) for r in cards.alias_map(spark, str(tmp_path / "aliases.json")).collect()} == {("Bo", "Boss"), ("Al", "Alpha")}
    (tmp_path / "Opened.txt").write_text("AAA\n\nbbb\n# no\naaa\n")
    assert {r.set for r in cards.opened_sets(spark, str(tmp_path / "Opened.txt")).collect()} == {"aaa", "bbb"}
    (tmp_path / "decks").mkdir()
    (tmp_path / "decks/a.txt").write_text("1 Sol Ring\n2 Sol Ring\n1 Rock (AAA) 7\n")
    (tmp_path / "decks/b.txt").write_text("1 sol ring\r\n")
    assert {r.item: r.decks for r in cards.deck_usage(spark, str(tmp_path / "decks"), names.collection_key).collect()} == {"sol ring": 2, "rock": 1}
    (tmp_path / "clusters").mkdir()
    for i in range(2):
        (tmp_path / f"clusters/cluster_{i}.csv").write_text(f"card_name,global_frequency,cluster_id\nx{i},{i}.5,{i}\n")
    assert {tuple(r) for r in cards.cluster_files(spark, str(tmp_path / "clusters")).collect()} == {("x0", 0.5, 0), ("x1", 1.5, 1)}
    (tmp_path / "corpus/Some_Leader").mkdir(parents=True)
    (tmp_path / "corpus/Some_Leader/1.csv").write_text("Card Name;Quantity;Commander\nA-Boss;1;YES\nIsland;9;NO\n")
    b, i = cards.popularity_corpus(spark, str(tmp_path / "corpus"))
    assert [r.leader for r in b.collect()] == ["Boss"] and sorted(r.item for r in i.collect()) == ["Boss", "Island"]
    t = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("never",)], "t string").select(cards.instant(F.col("t")).alias("t")).collect()
    assert t[0].t.hour == 3 and t[1].t is None


def test_writers(spark, tmp_path):
    rates = spark.createDataFrame([("A", i, float(i), 1) for i in range(5)] + [("B", 9, 1.0, 1)], "leader string, item long, rate double, n long")
    writers.write_rates(rates, f"{tmp_path}/r", 2)
    top = spark.read.option("header", True).csv(f"{tmp_path}/r/top")
    assert sorted((r.leader, r.item) for r in top.collect()) == [("A", "3"), ("A", "4"), ("B", "9")]
    writers.write_frequency(rates.select("item", F.col("rate").alias("frequency")), f"{tmp_path}/f", 2)
    assert [r.item for r in spark.read.option("header", True).csv(f"{tmp_path}/f/top").collect()] == ["4", "3"]
    writers.write_inclusion(rates, f"{tmp_path}/i")
    assert spark.read.option("header", True).csv(f"{tmp_path}/i").count() == 6
    profile = rates.select("leader", "item", "rate", F.lit(1.0).alias("idf"), F.col("rate").alias("tfidf"), F.lit(1.0).alias("tfidf_norm"))
    writers.write_profiles(profile, rates.groupBy("leader").count(), f"{tmp_path}/p", 3, 1)
    objects = {json.loads(r.value)["name"]: json.loads(r.value)["items"] for r in spark.read.text(f"{tmp_path}/p/json").collect()}
    assert [x["item"] for x in objects["A"]] == [4, 3, 2] and spark.read.option("header", True).csv(f"{tmp_path}/p/signatures").count() == 2
    writers.replace_table(rates, "rates_written")
    writers.replace_table(rates.limit(1), "rates_written")
    assert spark.table("rates_written").count() == 1
    spark.sql("DROP TABLE rates_written")
    writers.write_tables({"features": rates}, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/features").count() == 6


def test_names_of_leaders(spark):
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    totals = spark.createDataFrame([("amy", 5), ("zed", 9), ("amy + bo", 9)], "leader string, total long")
    got = {r.name: (r.leader, r.total) for r in advisor.partner_rates(n("amy + zed", "amy + bo", "nobody"), totals).collect()}
    assert got == {"amy + zed": ("zed", 9), "amy + bo": ("amy + bo", 9)}
    files = spark.createDataFrame([("my Zed deck",), ("The Lord of Boats",), ("boats",)], "stem string")
    got = {r.name: (r.stem, r["pass"]) for r in advisor.matched_files(n("Zed", "Boats, Lord", "Boats forever", "Nix"), files).collect()}
    assert got == {"Zed": ("my Zed deck", 1), "Boats, Lord": ("The Lord of Boats", 2), "Boats forever": ("The Lord of Boats", 3)}
    allowed = advisor.allowed_leaders(n("Éva", "Bo"), n("eva", "Cy"), names.collection_key)
    assert {tuple(r) for r in allowed.collect()} == {("eva", "Éva"), ("bo", "Bo"), ("cy", "Cy")}
    assert spark.range(1).select(advisor.first_type(F.lit("Legendary creature — land"), ["Land", "Creature"]).alias("t"), advisor.shortened(F.lit("x" * 300)).alias("s")).first()[:] == ("Land", "x" * 280 + "…")


def test_support_and_sync(spark):
    items = spark.createDataFrame([(b, "A", i) for b in range(4) for i in (1, 2, 10 + b)], "basket_id long, leader string, item long")
    mine = spark.createDataFrame([(1, 1), (1, 2), (1, 99)], "owner long, item long")
    got = {r.item: (r.rank, r.support) for r in popularity.pairwise_support(mine, items).collect()}
    assert got == {99: (1, 0), 1: (2, 4), 2: (3, 4)}
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "name string, changed long")
    since = spark.createDataFrame([("a", 3), ("b", 7)], "name string, synced long")
    assert {r.name: r.sync for r in catalogue.recently_changed(files, since).collect()} == {"a": True, "b": False, "c": True}
    named = spark.createDataFrame([("Plains",), ("plains",), ("Wastes",), ("Rock",)], "item string")
    assert {r.item for r in popularity.without_basics(named).collect()} == {"plains", "Rock"}
    bad = spark.createDataFrame([(1.0, float("nan")), (None, 2.0)], "x double, y double")
    assert {r.feature: r.empty for r in ml.empty_counts(bad, ["x", "y"]).collect()} == {"x": 1, "y": 1}


def test_flags_are_set_anew(spark):
    items = spark.createDataFrame([(1, "Sol Ring"), (2, "Éowyn"), (3, "Rock")], "item long, name string")
    told = spark.createDataFrame([("Sol Ring",), ("eowyn",), ("Unknown",)], "name string")
    got = catalogue.flagged(items, told, names.collection_key(F.col("name")))
    assert {r.item: r.flag for r in got.collect()} == {1: True, 2: True, 3: False}


def test_sections_of_recommendations(spark, tmp_path):
    from tallyloom.sources import lists

    add = spark.createDataFrame([(1, "Rock", 9), (2, "Day", 4)], "rank int, item string, score long")
    cut = spark.createDataFrame([(1, "Old", 0, 3)], "rank int, item string, support long, frequency long")
    lists.write_sections(add, cut, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).select("section", "rank", "item", "score", "support", "frequency").collect()
    assert sorted(tuple(r) for r in rows) == [("add", "1", "Rock", "9", None, None), ("add", "2", "Day", "4", None, None), ("remove", "1", "Old", None, "0", "3")]
