"""URL filter: host and path rules, then a blocked Bloom filter of listed URLs with an exact join behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: (host, path, verdict) of the query's rules (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The query lists the URLs of the pages whose id, as text, has an MD5 that starts so (fixed value).
LISTED_MD5 = "3"
#: Bits of a filter for each listed URL, probes of each URL in its block, and blocks of 256 bits that are broadcast at most (8 MB).
BITS_EACH, PROBES, MOST_BLOCKS = 12, 6, 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Empty where there is no ://."""
    there = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(there > 0, F.substring(url, there + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it and opens the path; null if none does."""
    fits = [
        (h, p, v, ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*[F.when(ok, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v, ok in fits], F.lit(None).cast("struct<rule:string,verdict:string>"))


def canonical(host: Column, path: Column) -> Column:
    """The URL that variants share: without scheme, port, www. or m., query, fragment and closing slash. Null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/$", "")))


def _probe(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and the four words of its bits there."""
    h, g = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    bits = [F.shiftrightunsigned(g, 8 * i).bitwiseAND(255) for i in range(PROBES)]
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.pmod(h, F.lit(blocks)).cast("int"), words


def blocked_bloom(urls: DataFrame, column: str = "url") -> tuple[DataFrame, int]:
    """(block, w0..w3) of a filter of the URLs, and its number of blocks, which grows with the list: a row of 40 bytes for about 20 URLs."""
    blocks = max(1, -(-urls.count() * BITS_EACH // 256))
    block, words = _probe(F.col(column), blocks)
    return urls.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def may_be_in(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """The rows whose value of the column passes the filter of listed[column], and a few others; nulls never do.

    The filter is broadcast up to MOST_BLOCKS blocks; a larger one meets the rows block by block, in a join.
    """
    bloom, blocks = blocked_bloom(listed, column)
    block, words = _probe(F.col(column), blocks)
    asked = rows.where(F.col(column).isNotNull()).withColumns({"__b": block, **{f"__p{i}": w for i, w in enumerate(words)}})
    bloom = bloom.select(F.col("block").alias("__b"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(4)])
    hit = asked.join(F.broadcast(bloom) if blocks <= MOST_BLOCKS else bloom.hint("merge"), "__b")
    for i in range(4):
        hit = hit.where(F.col(f"__w{i}").bitwiseAND(F.col(f"__p{i}")) == F.col(f"__p{i}"))
    return hit.select(rows.columns)


def in_list(rows: DataFrame, listed: DataFrame, column: str = "canonical") -> DataFrame:
    """The distinct non-null values of rows[column] that are in listed[column], exactly.

    The filter drops nearly all other values before the shuffle of the exact join.
    """
    return may_be_in(rows.select(column), listed, column).distinct().join(listed, column, "left_semi")


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page.

    A page takes its rule's verdict; without a rule it is blocked if its canonical URL is listed
    (column `canonical` of `listed`, distinct), else allowed. A null URL or one without :// has an empty host and
    path, no rule, and is allowed. Pages are judged row by row, so repeated rows are kept.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    hits = stored(in_list(rows, listed), "listed-hits").withColumn("listed", F.lit(True))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    with_url = rows.where("canonical IS NOT NULL").join(hits, "canonical", "left")  # rows without are no key of the join
    return with_url.unionByName(rows.where("canonical IS NULL").withColumn("listed", F.lit(None).cast("boolean")), allowMissingColumns=True).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: the distinct canonical URLs of the pages that LISTED_MD5 chooses by their ids. Other spellings of these URLs are listed too, other paths of their hosts are not."""
    host, path = host_and_path(F.col("url"))
    chosen = pages.where(F.startswith(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit(LISTED_MD5)))
    return chosen.select(host.alias("host"), path.alias("path")).select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical IS NOT NULL").distinct()


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page judged by the rules and by the list of URLs that some of the pages give."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, stored(listed_urls(pages), "listed-urls"))


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\.', '') || regexp_replace(path, '/$', '') END AS canonical FROM p
), rules(rhost, rpath, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
), l AS (
  SELECT DISTINCT canonical FROM c WHERE starts_with(md5(CAST(page_id AS VARCHAR)), '3') AND canonical IS NOT NULL
)
SELECT c.page_id, c.host, c.path, fit.rule AS rule, coalesce(fit.v, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND c.host = fit.host AND c.path = fit.path LEFT JOIN l ON c.canonical = l.canonical
"""
