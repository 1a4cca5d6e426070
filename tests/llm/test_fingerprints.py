import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import fingerprints as f

from .common import awkward, docs_frame, prose, saved


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 4
        yield i, t, (t[:-k] if k else t) + u[:k], u


def test_query_against_brute_force(spark, tmp_path):
    rows = awkward() + [(50, prose(120, 1)), (100, prose(80, 5)), (100, prose(80, 5))]
    got = f.op1_fingerprints(spark, saved(spark, tmp_path, rows)).collect()
    fp = {t: f.simhash(pa.array([t]))[0] for _, t, e, u in brute_edits(rows) for t in (t, e, u)}
    near = lambda a, b: float(f.likeness(fp[a][None], fp[b][None])[0])
    far = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b]).sum())
    texts = [t or "" for _, t in rows]
    want = sorted(
        ((i, len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, u), sum(far(t, x) <= f.RADIUS for x in texts) - 1 if i is not None and i % 50 == 0 else None) for i, t, e, u in brute_edits(rows)),
        key=str,
    )
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_near) for r in got), key=str) == want
    by = {}
    for r in got:
        if r.doc_id in (6, 7, 50):
            by.setdefault("same", set()).add(r.fingerprint)
    assert len(by["same"]) == 1


def test_one_and_no_documents(spark):
    one = f.fingerprint_edits(docs_frame(spark, [(5, "a b c d e")])).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 9
    assert f.fingerprint_edits(docs_frame(spark, [])).count() == 0


def test_votes():
    texts = ["a a a b", "x y z", ""]
    got = f.simhash(pa.array(texts), shingle=1)
    single = {w: f.simhash(pa.array([w]), 1)[0] for w in "ab"}
    assert (got[0] == single["a"]).all()  # three votes against one
    assert (got[2] == 0).all()
    assert (f.simhash(pa.array([None, "x y z"]), 1)[1] == got[1]).all()


@pytest.mark.parametrize("blocks,radius", [(4, 7), (5, 9), (8, 3), (3, 5)])
def test_tables_find_all_within_the_radius(spark, blocks, radius):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (12, 2), dtype=np.int64)
    rows = [base]
    for _ in range(12):
        flips = np.zeros_like(base)
        for i in range(len(base)):
            for b in r.choice(128, r.integers(0, 12), replace=False):
                flips[i, b // 64] ^= np.int64(np.uint64(1) << np.uint64(b % 64)) if b % 64 < 63 else np.int64(-(2**63))
        rows.append(base ^ flips)
    every = np.concatenate(rows)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in every], "fp_hi long, fp_lo long")
    got = {(x.fp_hi, x.fp_lo): x.n_near for x in f.neighbours(df, df, radius, blocks).collect()}
    u = every.view(np.uint64)
    for x in every:
        assert got[tuple(map(int, x))] == int((np.bitwise_count(u ^ x.view(np.uint64)).sum(1) <= radius).sum())


def test_texts_with_few_changes_are_found(spark):
    """One word of 150 changed: most copies are within the radius; other texts are not."""
    r = np.random.default_rng(1)
    texts = []
    for i in range(60):
        w = prose(150, 800 + i).split()
        texts.append(" ".join(w))
        w[int(r.integers(10, 140))] = "altered"
        texts.append(" ".join(w))
    fp = f.simhash(pa.array(texts))
    far = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(1)
    assert (far <= f.RADIUS).mean() >= 0.6
    assert np.bitwise_count(fp[:-2:2] ^ fp[2::2]).sum(1).min() > f.RADIUS
