"""Small tables with the awkward cases that every operator must handle."""

import random

from pyspark.sql import SparkSession

DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id string, key string, n string"
LETTERS = "abcdefghij"


def docs_frame(spark: SparkSession, rows):
    """documents with columns whose names clash with internal ones; rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", "x", None, "0") for i, t in rows], DOC)


def saved(spark: SparkSession, tmp_path, rows, table: str = "documents"):
    """A folder with that table, for the registered queries."""
    docs_frame(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def prose(n: int, seed: int = 0, words: int = 400) -> str:
    r = random.Random(seed)
    pool = ["".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(pool) for _ in range(n))


def awkward() -> list:
    """Null and empty texts, ties, repeats, many scripts, one very long word, a long text and a null id."""
    long = prose(6000, 9)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "a b c d e f g"), (6, prose(120, 1)), (7, prose(120, 1)),
        (8, prose(119, 1) + " changed"), (9, "é漢字😀 " * 40), (10, "x" * 9000), (11, long), (12, long + " tail"), (13, "12 34-56 " * 30),
        (15, "▁ literal ▁mark\u00a0and\u3000wide  spaces"), (16, "line\n" * 50), (20, prose(60, 3)), (None, "no id here at all"), (21, "<|endoftext|> <0x0A> 's don't"),
    ]
