"""Quality rules: a table of thresholds compiled into one projection of counts and ratios of each text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = """
the of and to a in is it that for was on with as be by are at this from
de la le les et en des un du une que est pour par dans avec qui sur au pas ou
der die und den von zu das sich mit auf für ist im nicht dem ein eine als auch es
el los las y se del por con no su para al lo como más
""".split()

#: measure, comparison under which a text is rejected, threshold. Ratios are compared as
#: 100 * numerator against threshold * denominator, so that all arithmetic is on integers.
THRESHOLDS = [
    ("n_words", ">", 100_000),
    ("word_chars / n_words", "<", 200),
    ("word_chars / n_words", ">", 1_400),
    ("n_symbols / n_words", ">", 30),
    ("n_stop_words / n_words", "<", 5),
    ("n_dup_lines / n_lines", ">", 50),
    ("n_repeat_words / n_words", ">", 50),
    ("n_shout_words / n_words", ">", 50),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def text_words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more, the first included.

    Windows are packed as 33 bits of their hash over the index, so one sort of numbers brings equal
    windows together; those that share the bits are compared as words, so the count is exact.
    """
    index = (1 << 31) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + d) for d in range(3)]

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~index)).bitwiseOR(i.cast("long"))))

    def twin(values: Column, i: Column, of: Callable[[Column], Column]) -> Column:
        own = of(F.get(values, i))
        return ((i > 0) & F.coalesce(of(F.get(values, F.greatest(i - 1, F.lit(0)))) == own, F.lit(False))) | F.coalesce(of(F.get(values, i + 1)) == own, F.lit(False))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + 3 - F.greatest(a["end"] - p, F.lit(0).cast("long"))).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    def exact(near: Column) -> Column:
        full = F.sort_array(F.transform(near, lambda p: F.struct(F.concat_ws(" ", *window(p.cast("int"))).alias("w"), p.alias("p"))))
        return let(full, lambda e: covered(F.sort_array(F.transform(F.filter(e, lambda x, i: twin(e, i, lambda y: y["w"])), lambda x: x["p"]))))

    found = let(packed, lambda s: let(F.transform(F.filter(s, lambda x, i: twin(s, i, lambda y: F.shiftright(y, 31))), lambda x: x.bitwiseAND(F.lit(index))), lambda near: F.when(F.size(near) > 0, exact(near)).otherwise(F.lit(0).cast("long"))))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(found)


def measures(text: Column) -> Column:
    """One struct of the counts that the thresholds name, of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!!")))).cast("long").alias("n_shout_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return let(text_words(text), lambda w: let(lines, lambda x: of(w, x)))


def rejected(m: Column, thresholds: list[tuple[str, str, int]] = THRESHOLDS) -> Column:
    """Whether any row of the table of thresholds rejects a text of these measures."""
    out = F.lit(False)
    for what, sign, limit in thresholds:
        over, _, under = what.partition(" / ")
        a, b = (100 * m[over], limit * m[under]) if under else (m[over], F.lit(limit))
        out = out | (a > b if sign == ">" else a < b)
    return out


def judged(docs: DataFrame, thresholds: list[tuple[str, str, int]] = THRESHOLDS) -> DataFrame:
    """All columns of docs with struct `quality` (the measures), base_failed and kept.

    A null text is empty: it has no words, fails the base and is not kept. Each row is judged by
    itself. Columns of docs with the three new names are replaced.
    """
    m = F.col("quality")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return docs.withColumn("quality", measures(F.col("text"))).withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected(m, thresholds))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "quality.*", "base_failed", "kept")


def quality_sql(table: str = "documents") -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = " OR ".join(f"100 * {a} {sign} {limit} * {b}" if b else f"{a} {sign} {limit}" for what, sign, limit in THRESHOLDS for a, _, b in [what.partition(" / ")])
    return rf"""
    WITH t AS (
      SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM {table})
    ), word AS (
      SELECT rid, unnest(w) AS a, unnest(range(len(w))) AS i FROM t
    ), three AS (
      SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)
    ), twice AS (
      SELECT rid, i, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS f FROM three
    ), inside AS (
      SELECT rid, bool_or(f) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM twice
    ), again AS (
      SELECT rid, count(*) FILTER (f) AS n FROM inside GROUP BY rid
    )
    SELECT *, coalesce(NOT base_failed AND NOT ({tests}), FALSE) AS kept FROM (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
        SELECT doc_id, len(w)::BIGINT AS n_words,
          length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
          (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
          len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
          coalesce(n, 0)::BIGINT AS n_repeat_words,
          len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
          len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_shout_words
        FROM t LEFT JOIN again USING (rid)))
    """


OP6_SQL = quality_sql()
