import math
from fractions import Fraction

import numpy as np

from tallyloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, whitened int"
NAN, INF = float("nan"), float("inf")


def saved(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(rows, width):
    """Plain whole numbers: (n, sums, scatter of n * x - S, deviation by row)."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(width)]
    z = [[n * a - b for a, b in zip(x, s)] for x in fit]
    c = [[sum(r[i] * r[j] for r in z) for j in range(width)] for i in range(width)]
    return kept, n, s, c


def random_rows(width=20, n=700, scale=1.0):
    r = np.random.default_rng(3)
    mix = r.normal(size=(width, width)) * scale
    rows = [(i, (r.normal(size=width) @ mix).tolist()) for i in range(n)]
    return rows + [(9000 + i, rows[0][1]) for i in range(300)] + [(5, rows[5][1]), (None, rows[6][1]), (8000, None), (8001, [NAN] + [0.0] * (width - 1)), (8002, [INF] * width), (8003, [None] * width), (8004, [1.0]), (8005, [])]


def check(spark, tmp_path, rows, width):
    got = whitening.op11_whitening(spark, saved(spark, tmp_path, rows)).collect()
    kept, n, s, c = brute(rows, width)
    v = np.array([[float(Fraction(x, n**3)) for x in row] for row in c])
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(width, whitening.COMPONENTS)
    assert len(got) == k * len(kept)
    dev = sorted(((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in kept), key=str)
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(dev), key=str)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9 * r.explained
    # rows of the result are the whitened fit list: mean 0 and covariance 1
    of = {i: x for i, x in kept}
    by = {}
    for r in got:
        if r.vec_id is not None:
            by.setdefault(tuple(of[r.vec_id]), {})[r.component] = r.whitened
    w = np.array([[b[j + 1] for j in range(k)] for b in by.values()])
    if None not in of:
        assert np.abs(w.mean(0)).max() < 1e-9 and np.abs(w.T @ w / len(w) - np.eye(k)).max() < 1e-9
    # each component is an eigenvector: what whitens is a projection of x - S / n
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(t, s)] for t in by])
    u = np.linalg.lstsq(x, w, rcond=None)[0] * np.sqrt(e[:k])
    assert np.abs(np.linalg.norm(u, axis=0) - 1).max() < 1e-8 and np.abs(v @ u - u * e[:k]).max() < 1e-8 * e[0]


def test_query_against_brute_force(spark, tmp_path):
    check(spark, tmp_path, random_rows()[:-7] + random_rows()[-6:], 20)


def test_scatter_of_large_numbers_is_exact(spark):
    r = np.random.default_rng(5)
    x = r.integers(-(1 << 50), 1 << 50, size=(9000, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(5)
    n, sums, most = whitening.moments(df, 5)
    assert n == 9000 and sums == [sum(map(int, x[:, j])) for j in range(5)] and most == int(np.abs(x).max())
    model = whitening.Whitening(n, sums, np.zeros(0), np.zeros((5, 0)), [], np.zeros(0, bool))
    z = x.astype(object) * n - np.array(sums, object)
    assert whitening.scatter(df, model, most) == (z.T @ z).tolist()


def test_primes_and_remainders():
    p = whitening.primes(10**60)
    assert len(set(p)) == len(p) and np.prod(p, dtype=object) > 10**60 and max(p) < 1 << whitening.PRIME_BITS
    assert whitening.STRIP * (max(p) // 2) ** 2 < 1 << 53
    for value in (0, 1, -1, 10**59, -(10**59) + 7):
        assert whitening.remaindered({q: value % q for q in p}) == value


def test_empty_constant_and_single(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    rows, model = whitening.whitened(empty)
    assert rows.count() == 0 and model.n == 0
    empty.write.parquet(f"{tmp_path}/e/embeddings.parquet")
    assert whitening.op11_whitening(spark, f"{tmp_path}/e").count() == 0
    same = whitening.op11_whitening(spark, saved(spark, f"{tmp_path}/s", [(i, [0.5, -0.25, 3.0]) for i in range(9)])).collect()
    assert len(same) == 27 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    # one dimension of three varies
    part = whitening.op11_whitening(spark, saved(spark, f"{tmp_path}/p", [(i, [0.5, float(i), 3.0]) for i in range(9)])).collect()
    assert {(r.component, r.explained) for r in part} == {(1, 1.0), (2, 0.0), (3, 0.0)} and all((r.whitened is None) == (r.component > 1) for r in part)
    # finite, but beyond a long once squared
    far = whitening.op11_whitening(spark, saved(spark, f"{tmp_path}/f", [(i, [3e38 * (i % 2), float(i)]) for i in range(4)])).collect()
    assert len(far) == 8 and all(r.deviation is None for r in far)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1, 2) for i in range(20)], "`a.b` long, `v.x` array<double>, x int, vec int")
    out, model = whitening.whitened(df, "a.b", "v.x", components=2)
    assert out.count() == 20 and model.identity_error < 1e-9 and model.n == 20
