"""A Spark session with the settings that results depend on."""

from pyspark.sql import SparkSession


def session(name: str = "tallyloom", **settings: str) -> SparkSession:
    """UTC, Arrow and adaptive execution with skew handling; other settings are the caller's."""
    builder = SparkSession.builder.appName(name)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map={**own, **{k.replace("_", "."): v for k, v in settings.items()}}).getOrCreate()
