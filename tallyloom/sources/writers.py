"""Writers: tables as CSV, JSON and Parquet, one part for each leader where readers want one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(*by) if by else out).csv(path)


def write_frequency(frequency: DataFrame, path: str, k: int = 100) -> None:
    """path/all: every item by falling frequency, then item; path/top: the first k."""
    ordered = frequency.orderBy(F.desc("frequency"), "item")
    write_csv(ordered, f"{path}/all")
    write_csv(ordered.limit(k), f"{path}/top")


def write_rates(rates: DataFrame, path: str, k: int = 100) -> None:
    """path/all: a part for each leader; path/top: the k items of each with the highest rates, ranked."""
    write_csv(rates, f"{path}/all", "leader")
    rank = F.row_number().over(W.partitionBy("leader").orderBy(F.desc("rate"), "item"))
    write_csv(rates.withColumn("rank", rank).where(F.col("rank") <= k), f"{path}/top", "leader")


def write_inclusion(rates: DataFrame, path: str) -> None:
    """leader, item, rate of all pairs as one table."""
    write_csv(rates.select("leader", "item", "rate"), path)


def replace_table(df: DataFrame, name: str) -> None:
    """The whole table is replaced: rows that are not in df are gone."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def write_profiles(profile: DataFrame, summary: DataFrame, path: str, k: int = 500, signatures: int = 20) -> None:
    """path/csv and path/json: the k first items of each leader; path/summary; path/signatures."""
    rank = F.row_number().over(W.partitionBy("leader").orderBy(F.desc("tfidf"), "item"))
    best = profile.withColumn("rank", rank).where(F.col("rank") <= k)
    write_csv(best, f"{path}/csv", "leader")
    items = F.sort_array(F.collect_list(F.struct("rank", "item", "rate", "idf", "tfidf", "tfidf_norm")))
    best.groupBy("leader").agg(F.to_json(F.struct(F.col("leader").alias("name"), items.alias("items"))).alias("value")).write.mode("overwrite").partitionBy("leader").text(f"{path}/json")
    write_csv(summary.orderBy("leader"), f"{path}/summary")
    write_csv(best.where(F.col("rank") <= signatures).orderBy("leader", "rank"), f"{path}/signatures")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name: vectors, neighbours, clusters, tag tables, features, deck analysis."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
