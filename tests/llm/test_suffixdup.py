import hashlib
import random

from tallyloom.llm import suffixdup

from .common import awkward, docs_frame, prose, saved


def brute(rows, length=400):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        for s in range(len(r) - length + 1):
            h = r[s : s + length]
            seen[h] = seen.get(h, 0) + 1
    for (i, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()


def rows_with_repeats():
    shared, other = prose(90, 71), prose(110, 72)
    assert len(shared.encode()) > 400
    rows = [r for r in awkward()]
    rows += [(100 + i, f"{prose(30 + i, 100 + i)} {shared} {prose(25, 200 + i)}") for i in range(12)]
    rows += [(200 + i, f"{prose(20, 300 + i)}{other[: 390 + 3 * i]}#{prose(20, 400 + i)}") for i in range(10)]
    rows += [(300, "ab" * 500), (301, "z" * 399), (302, "y" * 400), (303, "y" * 400), (304, prose(80, 5) * 3), (305, "é" * 300), (306, "è" * 300)]
    rows += [(400, prose(200, 8)), (400, prose(200, 8)), (401, "line of text\n" * 90)]
    return rows


def collected(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    rows = rows_with_repeats()
    assert collected(suffixdup.op2_suffix_dedup(spark, saved(spark, tmp_path, rows))) == sorted(brute(rows), key=str)


def test_hot_grams_and_small_shards(spark):
    rows = rows_with_repeats()
    assert collected(suffixdup.without_repeats(docs_frame(spark, rows), hot=1, shard_bytes=3000)) == sorted(brute(rows), key=str)
    assert collected(suffixdup.without_repeats(docs_frame(spark, rows), hot=6, shard_bytes=1000)) == sorted(brute(rows), key=str)


def test_random_letters(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab") * r.randint(1, 30) for _ in range(r.randint(0, 30)))) for i in range(60)]
    assert collected(suffixdup.without_repeats(docs_frame(spark, rows), length=64)) == sorted(brute(rows, 64), key=str)


def test_texts_stay_valid(spark):
    rows = [(1, "aé" + "x" * 420), (2, "bé" + "x" * 420), (3, "é" * 250), (4, "è" * 250), (5, None)]
    kept = {r.doc_id: r.kept_text for r in suffixdup.without_repeats(docs_frame(spark, rows)).collect()}
    assert kept[1] == "a" and kept[2] == "b" and kept[5] == ""
    assert suffixdup.without_repeats(docs_frame(spark, [])).count() == 0


def test_columns_of_any_name(spark):
    text = prose(120, 1)
    rows = [(i, text, i, "x", 2.0, "b", "s") for i in range(2)] + [(5, "short", 5, "y", 1.0, "b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 long, `a.b` string, t2 double, own_0 string, starts string")
    got = suffixdup.without_repeats(docs)
    assert got.columns[:7] == docs.columns
    assert sorted((r.doc_id, r.t1, r["a.b"], r.t2, r.own_0, r.starts, r.n_removed > 0) for r in got.collect()) == [(0, 0, "x", 2.0, "b", "s", True), (1, 1, "x", 2.0, "b", "s", True), (5, 5, "y", 1.0, "b", "s", False)]
