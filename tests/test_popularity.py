from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import popularity


def baskets(n=600, items=2000, seed=0):
    """Baskets in which some items are far commoner than others."""
    r = np.random.default_rng(seed)
    share = 1 / np.arange(1, items + 1) ** 1.1
    share /= share.sum()
    return {b: set(map(int, r.choice(items, size=12, p=share))) for b in range(n)}


def frames(spark, held, owners=40, seed=1):
    r = np.random.default_rng(seed)
    mine = {o: set().union(*(held[b] for b in r.choice(list(held), 4).tolist())) for o in range(owners)}
    return (
        spark.createDataFrame([(o, i) for o, s in mine.items() for i in s] * 2, "owner long, item long"),
        spark.createDataFrame([(b, i) for b, s in held.items() for i in s], "basket_id long, item long"),
        mine,
    )


def brute(held, mine, k):
    out = {}
    for o, own in mine.items():
        score = Counter()
        for s in held.values():
            for j in s - own:
                score[j] += len(s & own)
        out[o] = sorted((-n, j) for j, n in score.items() if n)[:k]
    return out


def test_scores_against_brute_force_and_rows_expanded(spark, monkeypatch):
    held = baskets()
    mine_df, items_df, mine = frames(spark, held)
    expanded = []
    whole = popularity.reaching

    def counted(*args):
        out = whole(*args)
        expanded.append(out.count())
        return out

    monkeypatch.setattr(popularity, "reaching", counted)
    got = defaultdict(list)
    for r in popularity.cooccurrence_scores(mine_df, items_df, 5).orderBy("owner", "rank").collect():
        got[r.owner].append((-r.score, r.item))
    assert got == brute(held, mine, 5)
    pairs = popularity.cooccurrence(items_df, mine_df)
    all_ = mine_df.distinct().join(pairs, "item").count()
    print("rows expanded", expanded, "of", all_)
    assert sum(expanded) < 0.6 * all_


def test_ties_and_few_items(spark):
    held = {b: {1, 2, 3, 4, 5, 6} for b in range(5)} | {9: {7}}
    mine_df, items_df, mine = frames(spark, held, owners=3)
    mine_df = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 99)], "owner long, item long")
    got = sorted((r.owner, r["rank"], r.item, r.score) for r in popularity.cooccurrence_scores(mine_df, items_df, 3).collect())
    assert got == [(0, 1, 2, 5), (0, 2, 3, 5), (0, 3, 4, 5), (1, 1, 3, 10), (1, 2, 4, 10), (1, 3, 5, 10)]
    assert popularity.cooccurrence_scores(mine_df.limit(0), items_df).count() == 0


def test_support_within_a_list(spark):
    held = {0: {1, 2, 3}, 1: {1, 2}, 2: {1, 9}, 3: {2, 9}}
    _, items_df, _ = frames(spark, held, owners=1)
    lists = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)] + [("b", 9)], "owner string, item long")
    got = {(r.owner, r.item): (r["rank"], r.support) for r in popularity.pairwise_support(lists, items_df).collect()}
    assert got == {("a", 4): (1, 0), ("a", 3): (2, 2), ("a", 1): (3, 3), ("a", 2): (4, 3), ("b", 9): (1, 0)}


def test_lists_travel_packed_and_names_count(spark, monkeypatch):
    values = np.array([-5, 3, 300, 1 << 40, 2, 7, 9], np.int64)
    head = np.array([True, False, False, False, True, False, True])
    data, upto = popularity._coded(values, head)
    got, which = popularity._decoded(data, upto[np.r_[np.flatnonzero(head), len(values)]])
    assert got.tolist() == values.tolist() and which.tolist() == [0, 0, 0, 0, 1, 1, 2]

    held = baskets(items=300)
    mine_df, items_df, mine = frames(spark, held)
    monkeypatch.setattr(popularity, "LISTS", 100)  # owners go on from one step to the next
    lists = popularity.reaching(mine_df.distinct(), popularity.packed(popularity.cooccurrence(items_df, mine_df).repartition(4, "item")))
    pairs = mine_df.distinct().join(popularity.cooccurrence(items_df, mine_df), "item").count()
    assert lists.count() < 0.2 * pairs and lists.selectExpr("sum(length(others)) AS s").first().s < 2 * pairs
    named = lambda df: df.withColumn("item", F.format_string("n%05d", "item"))
    got = defaultdict(list)
    for r in popularity.cooccurrence_scores(named(mine_df), named(items_df), 5).orderBy("owner", "rank").collect():
        got[r.owner].append((-r.score, int(r.item[1:])))
    assert got == brute(held, mine, 5)
    want = {(o, i): sum(len(s & own) - 1 for s in held.values() if i in s) for o, own in mine.items() for i in own}
    assert {(r.owner, r.item): r.support for r in popularity.pairwise_support(mine_df, items_df, None).collect()} == want


def test_pairs_of_baskets_are_no_rows_and_few_items_are_wanted(spark, monkeypatch):
    held = baskets(items=300)
    mine_df, items_df, mine = frames(spark, held)
    monkeypatch.setattr(popularity, "cooccurrence", None)
    monkeypatch.setattr(popularity, "PAIRS", 50)  # a basket goes on from one step to the next
    monkeypatch.setattr(popularity, "LISTS", 100)
    for wanted in (popularity.WANTED, 0):
        monkeypatch.setattr(popularity, "WANTED", wanted)
        got = defaultdict(list)
        for r in popularity.cooccurrence_scores(mine_df, items_df, 5).orderBy("owner", "rank").collect():
            got[r.owner].append((-r.score, r.item))
        assert got == brute(held, mine, 5)


def test_sums_of_numbers_that_fit_in_one_and_of_others():
    r = np.random.default_rng(2)
    owner, other, n, own = r.integers(-3, 3, 500), r.integers(-4, 4, 500), r.integers(1, 9, 500), r.integers(0, 2, 500)
    want = sorted((a, b, int(n[at].sum()), int(own[at].sum())) for a in set(owner.tolist()) for b in set(other.tolist()) if (at := (owner == a) & (other == b)).any())
    assert [tuple(map(int, x)) for x in zip(*popularity._summed(owner, other, n, own))] == want
    wide = np.where(other == 3, np.int64(1) << 62, np.where(other == -4, -(np.int64(1) << 62), other))
    assert [tuple(map(int, x[2:])) for x in zip(*popularity._summed(owner, wide, n, own))] == [x[2:] for x in want]


def test_additions_of_owners_of_all_the_first_items_and_of_two_leaders(spark):
    rates = spark.createDataFrame([(1, i, 1000 - i) for i in range(100)] + [(2, i, 500) for i in (7, 300)], "leader long, item long, n long")
    mine = [(0, 1, i) for i in range(30)] + [(1, 1, i) for i in range(0, 40, 2)] + [(2, 1, 50)] + [(2, 9, i) for i in range(30)] + [(3, 2, 7)]
    got = defaultdict(list)
    for r in popularity.additions(spark.createDataFrame(mine * 2, "owner long, leader long, item long"), rates, 5).orderBy("owner", "rank").collect():
        got[r.owner].append((r.item, r.score))
    # an item that the owner holds with another leader takes a place as well
    first = {0: range(30, 35), 1: range(1, 10, 2), 2: range(30, 35)}
    assert got == {o: [(i, 1000 - i) for i in items] for o, items in first.items()} | {3: [(300, 500)]}


def test_owners_in_waves_leave_no_shuffle_files(spark, monkeypatch):
    rows = [(b, int(i)) for b in range(120) for i in np.random.default_rng(b).choice(25, 4, replace=False)]
    items = spark.createDataFrame(rows, "basket_id long, item long")
    mine = items.select((F.col("basket_id") % 40).alias("owner"), "item").distinct()
    told = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    both = lambda: (told(popularity.cooccurrence_scores(mine, items, 5), "owner", "rank", "item", "score"), told(popularity.pairwise_support(mine, items, None), "owner", "item", "support"))
    want, released = both(), []
    monkeypatch.setattr(popularity, "WAVE", mine.count() // 3, raising=True)
    monkeypatch.setattr(popularity, "release", released.append, raising=True)
    assert both() == want and len(want[0]) == 200 and len(released) >= 8
