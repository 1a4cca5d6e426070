"""Connected components of links between rows, as rounds of joins (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are linked to its smallest neighbour or itself; and the table of those, to discard.

    That table is stored, so that adaptive execution can split the join at a hub.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the smallest id that can be reached from each.

    Each round is stored, so lineage stays short; hubs are handled by joins, never gathered in one
    task. Null ends are ignored; an empty table gives no rows.
    """
    now = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, old = seen, now
        large, least = _large_star(old)
        now = stored(_small_star(large), "links")
        discard(old, least)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
