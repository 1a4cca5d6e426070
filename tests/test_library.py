"""Operators on small literal tables, parsers, and each SQL twin on the smallest tables."""

import glob
import math
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators import catalogue, ml, popularity, stats, vectors
from tallyloom.plans import QUERIES, SQL
from tallyloom.sources import lists

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, want))


def test_rates_and_idf(spark):
    baskets = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "C")], "basket_id long, leader string")
    items = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (2, "A", "y"), (4, "B", "x")], "basket_id long, leader string, item string")
    rates = {(r.leader, r.item): (r.n, r.total, r.rate) for r in stats.leader_rates(items, baskets).collect()}
    assert rates == {("A", "x"): (2, 3, 66.6667), ("A", "y"): (1, 3, 33.3333), ("B", "x"): (1, 1, 100.0)}
    f = {r.item: (r.frequency, r.leaders, r.idf) for r in stats.global_frequency(items, baskets).collect()}
    assert f == {"x": (60.0, 2, 0.0), "y": (20.0, 1, round(math.log(2), 6))}  # C has no items, so two leaders count
    profile = {(r.leader, r.item): r.tfidf_norm for r in stats.tfidf(stats.leader_rates(items, baskets), stats.global_frequency(items, baskets)).collect()}
    assert profile == {("A", "x"): 0.0, ("A", "y"): 1.0, ("B", "x"): 0.0}


@pytest.mark.parametrize("rate,k,want", [(47.87, 7, 0.757), (35.08, 4, 0.751), (60.40, 10, 0.739)])
def test_published_examples(rate, k, want):
    assert abs(rate / 100 * math.log(34 / k) - want) < 0.002


def test_additions_and_removals_properties(spark):
    items = spark.createDataFrame([(b, "A", i) for b in range(6) for i in range(b, 9)], "basket_id long, leader string, item long")
    baskets = items.select("basket_id", "leader").distinct()
    mine = spark.createDataFrame([(1, "A", 8), (1, "A", 0), (1, "A", 99), (2, "A", 5)], "owner long, leader string, item long")
    rates, frequency = stats.leader_rates(items, baskets), stats.global_frequency(items, baskets)
    add = popularity.additions(mine, rates, 3).collect()
    assert [(r.owner, r.item) for r in sorted(add, key=lambda r: (r.owner, r.rank))] == [(1, 5), (1, 6), (1, 7), (2, 6), (2, 7), (2, 8)]
    gone = popularity.removals(mine, rates, frequency, 2).collect()
    assert [(r.owner, r.item, r.support) for r in sorted(gone, key=lambda r: (r.owner, r.rank))] == [(1, 99, 0), (1, 0, 1), (2, 5, 6)]


def test_name_keys(spark):
    df = spark.createDataFrame([(" A-Éowyn, Lórien's\t",), ("Æther Vial",), (None,)], "n string")
    got = df.select(names.popularity_key(F.col("n")), names.collection_key(F.col("n")), names.token_key(F.col("n")), names.file_key(F.col("n"))).collect()
    assert tuple(got[0]) == ("Éowyn, Lórien's", "a-eowyn, lorien's", "aeowyn_loriens", "AEowyn_Loriens")
    assert got[1][1] == "æther vial" and tuple(got[2]) == (None,) * 4


def test_list_lines(spark):
    lines = ["2 Sol Ring", "3x Island (ABC) 123", "Forest *F*", "# note", "// note", "", "  Tinúviel "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.item: r.qty for r in lists.collection(df, names.collection_key).collect()}
    assert got == {"sol ring": 2, "island": 3, "forest": 1, "tinuviel": 1}
    text = spark.createDataFrame([("f", "1 A // B\n2 C\n\n1 Leader, the First")], "file string, text string")
    rows = {r.name: (r.qty, r.is_leader) for r in lists.sectioned_list(text).collect()}
    assert rows == {"A // B": (1, False), "C": (2, False), "Leader, the First": (1, True)}


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "Some_Leader").mkdir()
    (tmp_path / "Some_Leader/1.csv").write_bytes("﻿Card Name;Quantity;Commander\nSol Ring;1;NO\nSol Ring;x;no\nIsland;9;NO\n;1;NO\nBoss;1; yes\n".encode())
    (tmp_path / "Some_Leader/2.csv").write_bytes("Card Name;Quantity;Commander\nCaf\xe9;2;NO\n".encode("latin-1"))
    rows = lists.corpus(spark, str(tmp_path))
    assert {(r.name, r.qty, r.is_leader) for r in rows.collect()} == {("Sol Ring", 1, False), ("Island", 9, False), ("Boss", 1, True), ("Café", 2, False)}
    b, i = lists.corpus_baskets(rows)
    assert sorted(r.leader for r in b.collect()) == ["Boss", "Some Leader"]
    assert sorted(r.item for r in i.collect()) == ["Café", "Sol Ring"]
    alias = spark.createDataFrame([("Boss", "The Boss")], "alias string, canonical string")
    assert [r.leader for r in lists.corpus_baskets(rows, alias)[0].collect()] == ["The Boss"]
    assert sorted(r.leader for r in lists.corpus_baskets(rows, alias.limit(0))[0].collect()) == ["Boss", "Some Leader"]


def test_nested_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data":{"name":"Deck","boards":{"commanders":{"cards":{"1":{"quantity":1,"card":{"name":"Zed"}},"2":{"quantity":1,"card":{"name":"Amy"}}}},"mainboard":{"cards":{"3":{"quantity":4,"card":{"name":"Rock"}}}}}}}')
    assert [tuple(r) for r in lists.nested_decks(spark, str(tmp_path / "d.json")).collect()] == [("Deck", "Amy + Zed", "Rock", 4)]


def test_index_and_faces(spark):
    t = spark.createDataFrame([(1, "A", "x", "5.5", "2"), (2, "A", "x", "6.5", "3"), (3, "A", "y", "bad", "1")], "at long, leader string, item string, rate string, n string")
    assert [tuple(r) for r in lists.frequency_index(t).collect()] == [("A", "x", 6.5, 3)]
    cards = spark.createDataFrame([(1, "c", None, None, [("2U",)], {"eur": "1.50", "usd": "n/a"})], "id long, name string, mana_cost string, cmc double, card_faces array<struct<mana_cost:string>>, prices map<string,string>")
    assert {(r.price_kind, r.mana_cost, r.price) for r in lists.face_rows(cards).collect()} == {("eur", "2U", Decimal("1.50")), ("usd", "2U", None)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, catalogue.upserted(old, new, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, catalogue.replaced_children(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    assert sorted(r.k for r in catalogue.inserted_if_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    prices = spark.createDataFrame([(1, 1, None), (1, 2, 3.0), (1, 3, 3.0), (2, 9, None)], "item long, printing long, price double")
    assert {r.item: (r.best, r.cheapest) for r in catalogue.best_printings(prices).collect()} == {1: (2, 3.0), 2: (9, None)}


def test_vectors_and_metrics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0)], "item long, vec array<double>, cluster int")
    n = {(r.item, r.neighbor): r.similarity for r in vectors.neighbours(v, v).collect()}
    assert n[1, 2] == 1.0 and n[1, 3] == 0.0 and (1, 1) not in n
    w = v.withColumn("w", F.lit(0.0))
    assert {r.value for r in vectors.weighted_means(w, "cluster").collect()} == {0.0}
    rows = spark.createDataFrame([("A", i, float(i), float(i)) for i in range(60)], "leader string, item long, t double, s double")
    assert all((r.precision, r.ndcg) == (1.0, 1.0) for r in ml.ranking_metrics(rows, "t", "s").collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_models_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_item_vectors(spark):
    lines = spark.createDataFrame([(b, i, 1) for b in range(40) for i in range(b % 5, b % 5 + 6)], "basket_id long, item long, qty long")
    assert len(ml.item_vectors(lines, size=8, epochs=1).first().vec) == 8


def test_neighbours_with_more_ties_than_asked_for(spark):
    # 300 copies of one vector, and 300 that are equal to it only after rounding
    rows = [(i * 7919 % 601, [1.0, 0.0]) for i in range(300)] + [(i * 7919 % 601, [1.0, 1e-4 * (i % 5)]) for i in range(300, 600)] + [(900, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "item long, vec array<double>")
    got = {}
    for r in vectors.neighbours(v.where("item IN (3, 900)"), v, 5).collect():
        got.setdefault(r.item, {})[r.rank] = (r.neighbor, r.similarity)
    for i, found in got.items():
        mine = dict(rows)[i]
        want = sorted((-round(sum(x * y for x, y in zip(mine, w)) / math.hypot(*mine) / math.hypot(*w), 6), j) for j, w in rows if j != i)[:5]
        assert [found[k + 1] for k in range(5)] == [(j, -s) for s, j in want]
    assert set(got) == {3, 900}
    assert vectors.rounded(np.array([0.0000005, -0.0000005, 0.1234565, -1e-9, 1.0])).tolist() == [1e-6, -1e-6, 0.123457, 0.0, 1.0]
