import math

import duckdb
import numpy as np

from tallyloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, n string, c string"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def saved(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(rows):
    v = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(c is not None and math.isfinite(c) for c in e):
            v.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in e)))
    v = sorted(set(v))
    out = []
    for a in v:
        if a[0] % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1], r) for r in v if r != a)
        for score, i, *_ in [x for x in s if x[2] == a[1]][:5]:
            fits = [(-t, j) for t, j, label, _ in s if label != a[1] and 80 * -score <= 100 * -t <= 100 * -score][:5]
            out += [(a[0], i, k + 1, j, -score, t) for k, (t, j) in enumerate(fits)]
    return sorted(out)


def sample(n=1500, width=8, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(10, width))
    rows = []
    for i in range(n):
        label = int(r.integers(10)) if i % 3 else 4  # one hot label
        rows.append((i, (centre[label] * 0.4 + r.normal(size=width)).astype(np.float32).tolist(), label))
    rows += [(2000 + i, rows[100][1], i % 10) for i in range(120)]  # ties
    rows += [(100, rows[100][1], rows[100][2]), (3000, None, 1), (3100, [float("nan")] * width, 1), (3200, [float("inf")] * width, 2), (3300, [None] * width, 3), (None, rows[0][1], 1), (3400, rows[1][1], None)]
    return rows


def test_query_against_brute_force_and_sql(spark, tmp_path, monkeypatch):
    rows = sample()
    path = saved(spark, tmp_path, rows)
    want = brute(rows)
    assert len(want) > 100
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, path).select(COLS).collect())) == want
    monkeypatch.setattr(negatives, "ENTRIES", 8 * 11)  # many blocks of both kinds
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, path).select(COLS).collect())) == want
    monkeypatch.undo()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT DISTINCT vec_id, embedding, label FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({negatives.OP12_SQL})").fetchall()) == want


def test_rows_that_share_an_id(spark, tmp_path):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.9, 0.1], 2), (1, [0.99, 0.0], 2), (2, [0.98, 0.0], 1)]
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, saved(spark, tmp_path, rows)).select(COLS).collect())) == brute(rows)


def test_large_scores(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=4) * 1e6).astype(np.float32).tolist(), i % 3) for i in range(300)]
    assert sorted(map(tuple, negatives.op12_hard_negatives(spark, saved(spark, tmp_path, rows)).select(COLS).collect())) == brute(rows)
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [9e29, 1.0], 2)]
    assert negatives.op12_hard_negatives(spark, saved(spark, f"{tmp_path}/h", huge)).count() >= 0
    x = np.array([[1 << 40, -(1 << 30)]])
    assert negatives.scores(x, x)[0, 0] == (1 << 62) - 1 and negatives.scores(x[:, :1] >> 12, x[:, :1] >> 12)[0, 0] == 1 << 56


def test_sorted_scores_and_limits():
    r = np.random.default_rng(0)
    for far in (1, 1 << 60):
        s = r.integers(-5, 5, size=(6, 50)) * far
        below, at = negatives.sorted_scores(s)
        for k in range(6):
            assert at[k].tolist() == sorted(range(50), key=lambda j: (-s[k, j], j)) and (below[k] == -s[k, at[k]]).all()
    assert [negatives.lower_limit(p, 80) for p in (10, 11, 0, -10, -11)] == [8, 9, 0, -8, -8]


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert negatives.op12_hard_negatives(spark, f"{tmp_path}/e").count() == 0
    assert negatives.op12_hard_negatives(spark, saved(spark, f"{tmp_path}/s", [(0, [1.0], 1)])).count() == 0
    assert negatives.op12_hard_negatives(spark, saved(spark, f"{tmp_path}/z", [(0, [], 1), (1, [], 1), (2, [], 2)])).count() == 1
