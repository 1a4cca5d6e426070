import random
import re

import numpy as np
import pytest

from tallyloom.llm import components, neardup

from .common import awkward, docs_frame, prose, saved


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    rows = list(awkward())
    for g in range(6):
        base = prose(150, 50 + g, 300)
        rows += [(1000 * (g + 1) + j, edited(base, j % 7, 31 * g + j)) for j in range(25)]
        rows += [(7000 + 10 * g + j, base.upper() if j else base) for j in range(3)]
    chain = prose(200, 77).split()
    rows += [(8000 + j, " ".join(chain[4 * j : 120 + 4 * j])) for j in range(12)]  # each like its neighbours only
    rows += [(9000 + j, prose(40, 5) + " " + prose(60, 200 + j)) for j in range(30)]  # a shared passage, no link
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = near_rows()
    rows.append(rows[30])
    got = neardup.op3_near_dedup(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r


def test_empty(spark):
    assert neardup.near_groups(docs_frame(spark, [])).count() == 0


def test_posterior_bounds():
    need = neardup.least_matches(0.8, 1e-6)
    assert (np.diff(need) >= 0).all() and need[-1] < 0.8 * 128
    r = np.random.default_rng(1)
    for n in (16, 64, 128):
        assert (r.binomial(n, 0.8, 200_000) < need[n - 1]).mean() < 1e-4  # true pairs stay
        assert (r.binomial(n, 0.2, 2_000) < need[n - 1]).mean() > (0.2 if n == 16 else 0.95)  # others go


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = {x.id: x.component for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_blocks_of_large_buckets_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    monkeypatch.setattr(neardup, "PAIRS", 7)
    rows = [(i, prose(30, 5) + " " + prose(6, 300 + i // 3)) for i in range(60)]
    got = neardup.near_groups(docs_frame(spark, rows), k=4).collect()
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_that_repeat_an_id(spark):
    a, b = prose(150, 61, 300), prose(150, 62, 300)
    rows = [(5, a), (5, b), (7, edited(b, 2, 1)), (3, edited(a, 2, 2)), (5, a), (None, edited(a, 1, 3)), (None, prose(80, 63)), (9, ""), (9, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_groups(docs_frame(spark, rows), k=4).collect()), key=str)
    want = [(5, 3, False), (5, 5, True), (7, 5, False), (3, 3, True), (5, 3, False), (None, 3, False), (None, None, True), (9, 9, True), (9, 9, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs_frame(spark, rows), k=4).collect()), key=str)
    assert left == sorted([(5, b), rows[3], rows[6], (9, "")], key=str)


def bucket_of(spark, n, depth=1):
    """One bucket of n components of one member each, whose signatures agree in `depth` bands only."""
    r = np.random.default_rng(3)
    sig = r.integers(0, 2**16, (n, neardup.BANDS * neardup.ROWS)).astype(np.uint16)
    sig[:, : neardup.ROWS * depth] = 5
    rows = spark.createDataFrame([(77, 1, i, 100, i) for i in range(n)], "key long, path long, id long, n long, c long")
    return rows, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "id long, sig binary")


def test_rows_grow_with_the_members_of_a_bucket(spark):
    for n in (2500, 10_000):
        rows, sigs = bucket_of(spark, n)
        wide = neardup.mixed(rows)[0].where(f"others > {neardup.WIDE}")
        split = neardup.split_by_band(wide, sigs)
        assert split.count() == (neardup.BANDS - 1) * n
        assert neardup.dealt_blocks(neardup.mixed(split)[0]).count() < n // 10
    rows, sigs = bucket_of(spark, 2000)
    dealt = neardup.dealt_blocks(neardup.mixed(rows)[0])
    assert dealt.count() <= (neardup.WIDE // neardup.GROUP + 1) * 2000
    assert neardup.partnered(dealt, sigs, 80).count() == 0


def test_wide_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    monkeypatch.setattr(neardup, "WIDE", 3)
    rows = [(50_000 + i, prose(30, 5) + " " + prose(6, 300 + i // 3)) for i in range(60)] + near_rows()
    got = neardup.near_groups(docs_frame(spark, rows), k=4).collect()
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


def test_pairs_of_wide_buckets_that_agree_in_one_band_only(spark, tmp_path, monkeypatch):
    """However wide a bucket is, all its pairs are compared: members 2i and 2i + 1 are alike, and all agree in the first band alone."""
    n, r = 60, np.random.default_rng(4)
    sig = r.integers(0, 2**16, (n, neardup.BANDS * neardup.ROWS)).astype(np.uint16)
    sig[1::2] = sig[::2]
    sig[1::2, neardup.ROWS :: neardup.ROWS] += 1
    sig[:, : neardup.ROWS] = 5
    common = np.arange(10**6, 10**6 + 60, dtype=np.uint64)
    sets = [np.sort(np.r_[common, 1000 * (i // 2) + np.arange(36, dtype=np.uint64), 1000 * (n + i) + np.arange(4, dtype=np.uint64)]) for i in range(n)]
    rows = spark.createDataFrame([(77, 1, i, 100, i) for i in range(n)], "key long, path long, id long, n long, c long")
    sigs = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "id long, sig binary")
    full = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "id long, set binary")
    want = {(i, i + 1) for i in range(0, n, 2)}

    def links():
        some, wide = neardup.links_of_bands(rows, sigs, full, 80)
        rest = [] if wide is None else neardup.links_of_rest(rows.join(wide, "key", "left_semi"), sigs, full, 80).collect()
        return {(x.a, x.b) for x in [*some.collect(), *rest]}, wide is not None

    assert links() == (want, False)
    monkeypatch.setattr(neardup, "WIDE", 3)
    assert links() == (want, True)
    split = neardup.split_by_shingle(neardup.mixed(rows)[0], full, 80)
    assert split.count() <= 21 * n and {r.path for r in split.collect()} == {0}


def test_columns_of_any_name(spark):
    text = prose(80, 4)
    rows = [(1, text, "u1", 7, "k"), (2, text, "u2", 8, "k"), (3, "other words here", "u3", 9, "k"), (4, None, "u4", 10, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __t1 long, `a.b` string")
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2], rows[3]]
