import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import archive

SCHEMA = "page_id long, url string, html string, digest string, payload string, first string, n_bytes int"
BIG = "<p>équal 漢字</p>" * 20
COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA)


def pages():
    rows = [(i, f"http://h/{i % 7}?a=\r\nb c\u007f", BIG) for i in range(40, 10, -3)]  # copies
    rows += [(100 + i, "http://x/", "small") for i in range(5)] + [(110, None, None), (111, "", ""), (112, "é", None), (113, "u", "x" * 99), (114, "u", "x" * 99), (115, "u", "y" * 100), (116, "u", "y" * 100)]
    rows += [(200, "u", "é" * 50), (201, "u", "é" * 50), (202, "u", "z" * 300_000), (203, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (204, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9)]
    return rows


def want(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        first[p] = min(first.get(p, i), i)
    return sorted((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if (again := len(p) >= 100 and first[p] != i) else "response", first[p] if again else None) for i, p in data)


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = pages()
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, archive.op13_warc_archive(spark, str(tmp_path)).select(COLS).collect()))
    assert got == want(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLS)} FROM ({archive.OP13_SQL})").fetchall()) == got


@pytest.mark.parametrize("gzip", [True, False])
def test_files_round_trip(spark, tmp_path, gzip):
    rows = pages()
    at, to = f"file://{tmp_path}/a", f"file://{tmp_path}/w"
    archive.write(frame(spark, rows).repartition(3), at)
    assert spark.read.parquet(f"{at}/payloads").count() == len({h or "" for _, _, h in rows})
    whole = archive.restored(spark, at).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in whole) == sorted((i, (h or "").encode()) for i, _, h in rows)
    archive.export(spark, at, to, gzip)
    back = archive.imported(spark, to).collect()
    end = b"\r\n\r\n"
    assert sorted(bytes(r.header) + bytes(r.payload) + end for r in back) == sorted(bytes(r.record) for r in whole)
    kept = {i for i, _, _, kind, _ in want(rows) if kind == "response"}
    id_of = lambda head: next(int(x[11:]) for x in head.split(b"\r\n") if x.startswith(b"X-Page-Id: "))
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == (texts[id_of(bytes(r.header))] if id_of(bytes(r.header)) in kept else b"") for r in back)
    # every record that a revisit refers to is there, under its own id
    line = lambda head, name: [x.split(b": ", 1)[1] for x in head.split(end)[0].split(b"\r\n") if x.startswith(name + b": ")]
    ids = {line(bytes(r.header), b"WARC-Record-ID")[0] for r in back}
    refers = [line(bytes(r.header), b"WARC-Refers-To")[0] for r in back if line(bytes(r.header), b"WARC-Type") == [b"revisit"]]
    assert len(ids) == len(rows) and refers and set(refers) <= ids


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(5, "u", BIG), (5, "u", BIG), (5, "v", BIG), (None, "u", BIG), (9, "u", BIG), (None, "q", "w" * 200), (None, "q", "w" * 200)]
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = archive.op13_warc_archive(spark, str(tmp_path)).collect()
    big = [r for r in got if r.payload_bytes != 200]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in big) == [(0, "revisit", 5), (5, "response", 0), (5, "revisit", 5), (5, "revisit", 5), (9, "revisit", 5)]
    assert sorted((r.record_type, r.refers_to) for r in got if r.payload_bytes == 200) == [("response", None), ("revisit", None)]


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert archive.op13_warc_archive(spark, str(tmp_path)).count() == 0


def test_a_changed_payload_or_a_lost_one_is_an_error(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    archive.write(frame(spark, pages()), at)
    spark.read.parquet(f"{at}/payloads").withColumn("payload", F.when(F.length("payload") == 100, F.lit(b"forged")).otherwise(F.col("payload"))).write.parquet(f"{at}-forged/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        archive.payloads(spark, f"{at}-forged").collect()
    spark.read.parquet(f"{at}/payloads").where("length(payload) <> 5").write.parquet(f"{at}-lost/payloads")
    spark.read.parquet(f"{at}/headers").write.parquet(f"{at}-lost/headers")
    with pytest.raises(Exception, match="a payload is missing"):
        archive.restored(spark, f"{at}-lost").collect()
