import duckdb
import pytest

from tallyloom.llm import quality as q

from .common import awkward, docs_frame, prose, saved

SPACE = " \t\n\x0b\f\r"


def brute(text):
    t = text or ""
    words, cur = [], ""
    for c in t + " ":
        if c in SPACE:
            words, cur = words + [cur] if cur else words, ""
        else:
            cur += c
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + d for i in at for d in range(3)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


ROWS = [
    *awkward(), (40, "a b c a b c a b c x " * 9), (41, "p q r p q r p"), (42, "a a a a"), (43, "#tag* $5 <b> " * 30), (44, "same line\n\nsame line\r\nother\nsame line"),
    (45, "the of and to " + prose(100, 7) + " the of and in it is that for was on"), (45, "twice the id"),
]


def test_against_brute_force(spark, tmp_path):
    got = q.op6_quality_rules(spark, saved(spark, tmp_path, ROWS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in ROWS), key=str)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert {r.doc_id: r.kept for r in got}[45] in (True, False)


def test_verdicts(spark):
    clean = "the house of words and it is a place to be in for that was on with " * 1 + " ".join(f"word{i}" for i in range(80)) + " the end of it and so on to a close"
    rows = [(1, clean), (2, clean.replace(" ", "### ")), (3, " ".join(f"w{i}" for i in range(90))), (4, None)]
    kept = {r.doc_id: r.kept for r in q.judged(docs_frame(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_plan_has_no_python(spark):
    plan = q.judged(docs_frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_sql_twin(spark, tmp_path):
    path = saved(spark, tmp_path, [r for r in ROWS if r[0] not in (9,)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shout_words", "base_failed", "kept"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({q.OP6_SQL})").fetchall()
    got = [tuple(r[c] for c in cols) for r in q.op6_quality_rules(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark):
    assert q.judged(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [3, 4, 5])
def test_overlaps(spark, n):
    t = " ".join(["z"] * n)
    assert q.judged(docs_frame(spark, [(1, t)])).select("quality.n_repeat_words").first()[0] == (n if n > 3 else 0)
