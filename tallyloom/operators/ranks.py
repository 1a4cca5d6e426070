"""Places of rows, and quantiles of groups, without a task that holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def ranked(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """rows with `rank`, the place of each in that order, from 1: ranges are sorted side by side, and numbered from where the one before ends."""
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", before).drop("n")  # a row for each range
    place = F.row_number().over(W.partitionBy("range").orderBy(*order))
    return ranges.withColumn("rank", place).join(F.broadcast(starts), "range").withColumn("rank", F.col("rank") + F.col("start")).drop("range", "start")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(*keys, n, quantiles): the exact quantiles of the non-null values of each group, between neighbours by distance, in the order of shares.

    Equal values are counted first, so that none weighs more than a row; distinct ones are ordered in ranges across groups.
    A range knows what of its groups lies before it, and looks up the values at the places asked for. No group meets
    in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    ranges = stored(counted.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v").withColumn("range", F.spark_partition_id()), "ranges")
    same = F.lit(True)
    own = [F.col(k) for k in keys]
    # a row for each range and group in it
    parts = ranges.groupBy(*keys, "range").agg(F.sum("m").alias("part"))
    group = W.partitionBy(*own) if keys else W.partitionBy(same)
    parts = parts.withColumn("start", F.coalesce(F.sum("part").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("part").over(group)).drop("part")
    inner = F.sum("m").over(W.partitionBy("range", *own).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys] + [F.col("a.range") == F.col("b.range")]
    both = ranges.withColumn("inner", inner).alias("a").join(parts.alias("b"), match).select(*[F.col(f"a.{c}").alias(c) for c in keys], "v", "m", "n", (F.col("start") + F.col("inner")).alias("upto"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)])
    holds = lambda place: (place < F.col("upto")) & (place >= F.col("upto") - F.col("m"))
    low, high = F.floor("x.at"), F.ceil("x.at")
    each = both.withColumn("x", F.explode(wanted)).where(holds(low) | holds(high))
    values = each.groupBy(*keys, "n", "x").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    between = F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - F.col("x.at")) * F.col("a") + (F.col("x.at") - low) * F.col("b"))
    return values.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("x.i", between.alias("q")))), lambda x: x["q"]).alias("quantiles"))
