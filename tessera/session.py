"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", **settings: str) -> SparkSession:
    """Adaptive execution on, UTC, ANSI errors. Cluster settings come from spark-submit; ``settings`` add to them."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
