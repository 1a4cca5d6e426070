"""Content-addressed WARC archive: each distinct payload once by its SHA-256, the exact header of every record apart, records by a join.

An archive is a folder with two tables:

    payloads  digest, payload        one row for each distinct payload
    headers   digest, header         one row for each record: the bytes before its payload, exact

A record is header + payload + CRLF CRLF; a `revisit` has no payload of its own, and gets that of the record it
refers to from the same row of payloads. A digest is verified three times: equal digests must come with equal
lengths and second hashes when written, what is read must hash to its digest, and each header must find its payload.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import shared_dir

#: Bytes from which on an equal payload is a revisit (fixed value).
LEAST_BYTES = 100
#: What a crawl would know and the tables do not: the time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Records of an exported file at most.
FILE_RECORDS = 10_000


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))


def _uri(url: Column) -> Column:
    """A URL on one line: bytes of control characters and blanks are percent-encoded."""
    out = url
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A UUID of the record's name and payload; the same for repeated rows."""
    known = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(known, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def header(row: dict[str, Column]) -> Column:
    """The bytes of a WARC record before its payload: WARC header and HTTP header, each closed by an empty line.

    row: page_id, url, digest, n_bytes, response (boolean), first_id and first_url (the response's, of a revisit).
    """
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), row["n_bytes"].cast("string"), F.lit(CRLF * 2))
    revisit = lambda c: F.when(~row["response"], c)
    lines = [
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(row["response"], "response").otherwise("revisit")),
        _line("WARC-Record-ID", record_id(row["page_id"], row["url"], row["digest"])),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _uri(row["url"])),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), row["digest"])),
        _line("WARC-Profile", revisit(F.lit(PROFILE))),
        _line("WARC-Refers-To", revisit(record_id(row["first_id"], row["first_url"], row["digest"]))),
        _line("WARC-Refers-To-Target-URI", revisit(_uri(row["first_url"]))),
        _line("X-Page-Id", row["page_id"].cast("string")),
        _line("X-Refers-To-Page-Id", revisit(row["first_id"].cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.length(http.cast("binary")) + F.when(row["response"], row["n_bytes"]).otherwise(0)).cast("string")),
        F.lit(CRLF),
        http,
    ]
    return F.concat(*lines).cast("binary")


def field(head: Column, name: str) -> Column:
    """The value of a header line of the WARC part; null without that line."""
    found = F.regexp_extract(F.substring_index(head.cast("string"), CRLF * 2, 1), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def checked(ok: Column, value: Column, fault: str) -> Column:
    """value, or an error where the condition does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(fault)).cast("string"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Writes the archive of (page_id, url, html): a record for each row.

    A null html is an empty payload; a null url gives no target, a null id no id. Of equal payloads of `least` bytes or
    more the record with the smallest page_id (null last; of several rows with it the smallest url, null first; of rows
    equal in these, any one) is the response; shorter ones are all responses. Each task sends every distinct payload
    of its rows once, however many records share it, and headers travel without payloads.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("n_bytes"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    other = F.xxhash64("payload")
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(order).alias("first"), F.count("*").alias("records"), F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("n_most"), F.min(other).alias("h"), F.max(other).alias("h_most"))
    same = (F.col("n_bytes") == F.col("n_most")) & (F.col("h") == F.col("h_most"))
    once.select(checked(same, F.col("digest"), "payloads with one digest differ").alias("digest"), "payload", "n_bytes", "first", "records").write.option("compression", "zstd").parquet(f"{path}/payloads")
    shared = spark.read.parquet(f"{path}/payloads").where((F.col("records") > 1) & (F.col("n_bytes") >= least)).select("digest", "first")
    records = rows.drop("payload").join(shared, "digest", "left")
    named = (F.col("page_id").eqNullSafe(F.col("first.page_id"))) & (F.col("url").eqNullSafe(F.col("first.url"))) & F.col("first").isNotNull()
    # rows equal to the first in id and URL: the first of them is the response
    equal = records.where(named).withColumn("response", F.row_number().over(W.partitionBy("digest", "page_id", "url").orderBy("n_bytes")) == 1)
    rest = records.where(~named).withColumn("response", F.col("first").isNull())
    both = equal.unionByName(rest)
    cols = {c: F.col(c) for c in ("page_id", "url", "digest", "n_bytes", "response")} | {"first_id": F.col("first.page_id"), "first_url": F.col("first.url")}
    both.select("digest", header(cols).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, n_bytes) of the archive, each hashed again; a payload that does not match its digest is an error."""
    p = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return p.select(checked(F.sha2("payload", 256) == F.col("digest"), F.col("digest"), "a payload does not match its digest").alias("digest"), "payload", F.length("payload").cast("long").alias("n_bytes"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header, page_id, record_type, refers_to) of every record, read from its header's bytes."""
    h = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    told = field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha256:"), F.col("digest"))
    return h.select(
        checked(told, F.col("digest"), "a header names another digest").alias("digest"), "header", field(F.col("header"), "X-Page-Id").cast("long").alias("page_id"),
        field(F.col("header"), "WARC-Type").alias("record_type"), field(F.col("header"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, n_bytes, record, payload): every record's bytes as a WARC file has them, and its full payload.

    The join has as many rows as there are records; a header whose payload is missing is an error.
    """
    p = payloads(spark, path)
    both = headers(spark, path).join(p, "digest", "left").withColumn("digest", checked(F.col("n_bytes").isNotNull(), F.col("digest"), "a payload is missing"))
    end = F.lit(CRLF * 2).cast("binary")
    record = F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary")), end)
    return both.select("page_id", "record_type", "refers_to", "digest", "n_bytes", record.alias("record"), "payload")


def export(spark: SparkSession, path: str, to: str, gzip: bool = True) -> None:
    """Writes the records as WARC files (FILE_RECORDS of them each) that any reader of the format opens."""
    text = restored(spark, path).select(F.expr("cast(substring(record, 1, length(record) - 4) as string)").alias("value"))
    text.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip" if gzip else "none").text(to)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header with the HTTP part's, payload) of each record of a WARC file's bytes, by their content lengths."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        lines = dict(x.split(b": ", 1) for x in data[at:stop].split(b"\r\n")[1:] if b": " in x)
        end = stop + int(lines[b"Content-Length"])
        body = data.index(b"\r\n\r\n", stop, end) + 4
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield data[at:body], data[body:end]
        at = end + 4


def imported(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record of the WARC files in a folder, gzipped or not; a task holds one file."""
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                raw = data.as_py()
                found = list(split_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                for lo in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found[lo : lo + 256])], ["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary")


def op13_warc_archive(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and read back from it."""
    path = f"{shared_dir(spark)}/tallyloom/archive-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    sizes = payloads(spark, path).select("digest", "n_bytes")
    return headers(spark, path).join(sizes, "digest", "left").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
