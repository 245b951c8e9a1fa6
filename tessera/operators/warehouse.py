"""Keyed writes as new tables: upserts, replaced partitions, overlays; and reads that keep their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, ``update`` columns are the new row's and the rest stay."""
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in old.columns if c not in key], F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, key, "full")
    pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(*[F.col(c) if c in key else pick(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def replace_partitions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows but for the keys that ``new`` has, then all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def overlay(rows: DataFrame, corrections: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Each key's last correction in place of the value; the raw one is kept, and corrected tells which."""
    last = corrections.groupBy(*key).agg(F.max(F.struct("ts", "new_value")).alias("_c")).select(*key, F.col("_c.new_value").alias("_v"))
    j = rows.join(last, key, "left")
    return j.withColumn("raw_value", F.col(value)).withColumn("corrected", F.col("_v").isNotNull()).withColumn(value, F.coalesce("_v", value)).drop("_v")


def latest(rows: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """The row of the greatest ``order`` of each key among those with a value."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dense(left: DataFrame, names: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Every row of ``left`` with every name of a fixed list, and the value where there is one."""
    return left.crossJoin(F.broadcast(names)).join(values, on, "left")


def stats(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Number, mean, median, least and greatest of the values that aren't null."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v.cast("decimal(20,8)")), 4).cast("double").alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows were added, removed or changed; equal tables give none."""
    gone, new = before.exceptAll(after).select(*key).withColumn("_o", F.lit(1)), after.exceptAll(before).select(*key).withColumn("_o", F.lit(2))
    return gone.union(new).groupBy(*key).agg(F.sum(F.col("_o")).alias("_s")).select(*key, F.when(F.col("_s") == 1, "removed").when(F.col("_s") == 2, "added").otherwise("changed").alias("change"))


def require(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, unless ``bad`` has rows: an error that names the rule."""
    if not bad.isEmpty():
        raise ValueError(message)
    return df


def with_metadata(companies: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Companies with the columns of their metadata (one row a key) in place of their own; metadata of others is left out.

    A company without metadata is an error, and none is changed."""
    missing = companies.join(metadata, key, "left_anti")
    m = metadata.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    j = require(companies, missing.limit(1), "a company has no metadata").join(m, key)
    own = [F.col(f"_m_{c}").alias(c) if c in columns else F.col(c) for c in companies.columns]
    return j.select(*own, *[F.col(f"_m_{c}").alias(c) for c in columns if c not in companies.columns])
