"""Objects of a JSON array, read by many tasks.

The file is cut at closing braces by Spark's text reader, which splits it by byte ranges. Whether a brace stands in a string,
how deep it stands, and which object it belongs to are running sums over the pieces: of the quotes, then of the
braces outside strings, then of the objects that ended. A sum runs within a byte range, and starts at the total of
the ranges before it. Pieces of one object are then put together, wherever its bytes were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Scratch, stored

RANGE = ["file", "block"]


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows of the file before each, and its own: (file, block, i) is their order."""
    inner = F.sum(value).over(W.partitionBy(*RANGE).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = rows.groupBy(*RANGE).agg(F.sum(value).alias("t"))
    before = F.sum("t").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select(*RANGE, F.coalesce(before, F.lit(0)).alias("start"))  # a row for each byte range
    return rows.withColumn("inner", inner).join(starts, RANGE).withColumn(name, F.col("start") + F.col("inner")).drop("inner", "start")


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("long")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): the text of each object of the JSON arrays at path, numbered from 0 within its file; a stored table.

    The files are arrays of objects, in any layout. What is no valid JSON breaks off the objects after it.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)  # outside and inside strings in turn
    opened = lambda odd: F.aggregate(F.transform(parts, lambda p, at: F.when(at % 2 == odd, _count(p, "{")).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    with Scratch() as keep:
        pieces = keep(raw.select("*", (F.size(parts) - 1).cast("long").alias("quotes"), opened(0).alias("outside"), opened(1).alias("inside")), "pieces")
        # at its end a piece is inside a string if the quotes so far are odd; the brace there closes nothing then
        slim = running(pieces.drop("value"), F.col("quotes"), "q")
        odd, began = F.col("q") % 2 == 1, (F.col("q") - F.col("quotes")) % 2 == 1
        slim = keep(slim.select(*RANGE, "i", F.when(began, F.col("inside")).otherwise(F.col("outside")).alias("opens"), F.when(odd, 0).otherwise(1).alias("closes")), "braces")
        depth = keep(running(slim, F.col("opens") - F.col("closes"), "depth").select(*RANGE, "i", ((F.col("closes") == 1) & (F.col("depth") == 0)).cast("long").alias("ends")), "depths")
        number = running(depth, F.col("ends"), "n").select(*RANGE, "i", (F.col("n") - F.col("ends")).alias("number"))
        whole = pieces.select(*RANGE, "i", "value").join(number, [*RANGE, "i"]).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "i", "value"))).alias("x"))
        text = F.concat(F.array_join(F.transform("x", lambda p: p["value"]), "}"), F.lit("}"))
        return stored(whole.select("file", "number", F.regexp_replace(text, r"^[\s,\[\]]+", "").alias("value")).where(F.startswith("value", F.lit("{"))), "objects")
