import random

from pyspark.sql import functions as F

from tallyloom.operators import advisor, grams, ranks

NAMES = ["Red Bolt", "Blue bolt", "red", "ré", "Bolt of Red", "", None, "a", "ab", "aba", "Ärger", "x%y_z", "red"]


def test_index_equals_a_scan(spark):
    names = spark.createDataFrame(list(enumerate(NAMES)), "item long, name string")
    index = grams.built(names)
    for text in ("red", "RED", "bolt", "o", "ab", "", "zzz", "%", "d b", "Bolt of Red!", "ä", "ré"):
        want = {i for i, n in enumerate(NAMES) if n is not None and text.lower() in n.lower()}
        assert {r.item for r in index.containing(text).collect()} == want, text
        assert {r.item for r in index.starting(text).collect()} == {i for i, n in enumerate(NAMES) if n is not None and n.lower().startswith(text.lower())}, text
    texts = spark.createDataFrame([(t,) for t in ("red", "RED", "bolt", "o", "", "zzz", None)], "text string")
    got = {(r.text, r.item) for r in index.holding(texts).collect()}
    assert got == {(t, i) for t in ("red", "RED", "bolt", "o", "zzz") for i, n in enumerate(NAMES) if n and t.lower() in n.lower()}
    none = grams.built(names.limit(0))
    assert none.containing("a").count() == none.holding(texts).count() == none.starting("").count() == 0


def test_postings_are_read_by_gram(spark):
    names = spark.createDataFrame([(i, f"name {i} of many") for i in range(200)], "item long, name string")
    plan = grams.built(names).containing("17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram" in plan


def test_matched_files_against_all_pairs(spark):
    r = random.Random(3)
    words = ["able", "baker", "of", "charlie", "x", "delta", "echo!"]
    some = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
    names, stems = [some().title() for _ in range(60)] + ["Delta Foxtrot"], [some() + "-" + some() for _ in range(40)]
    plain = lambda s: "".join(c if c.isascii() and (c.islower() or c.isdigit() or c == " ") else " " for c in s.lower())
    want = {}
    for name in set(names):
        n = plain(name).strip()
        long = [w for w in n.split() if len(w) >= 4]
        hits = [(1, s) for s in stems if n in plain(s)] + [(2, s) for s in stems if long and all(w in plain(s) for w in long)] + [(3, s) for s in stems if long and long[0] in plain(s)]
        if hits:
            want[name] = min(hits)
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {x.name: (x["pass"], x.stem) for x in advisor.matched_files(df(names, "name"), df(stems, "stem")).collect()}
    assert got == want and {p for p, _ in want.values()} == {1, 2, 3}
    assert advisor.matched_files(df(names, "name"), df([], "stem")).count() == 0


def test_ranks_equal_a_window(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 977).alias("a"), "id").repartition(9)
    got = {(r.a, r.id): r["rank"] for r in ranks.ranked(rows, ["a", "id"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))} and len(got) == 5000
    assert ranks.ranked(rows.limit(0), ["a"]).count() == 0
