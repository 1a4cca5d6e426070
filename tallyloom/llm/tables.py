"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored

__all__ = ["discard", "free_names", "partitions", "quoted", "shared_dir", "stored"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    """The column of that very name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: list[str], n: int) -> list[str]:
    """n column names that are not taken, in any case of letters."""
    lower = {c.lower() for c in taken}
    return [name for i in range(n + len(taken)) if (name := f"own_{i}") not in lower][:n]
