"""Windows over the event stream. Each function takes a batch or a streaming frame and gives the same rows for either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a stream of events, with a watermark."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def batch(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and sums by window and type."""
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n", F.col("v").cast("double").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events no further apart than ``gap``."""
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("session_start"), "n")


def latest_by_user(events: DataFrame) -> DataFrame:
    """The last event of each user."""
    g = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("user_id", "m.event_id", "m.event_type")


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """Each key's events once: of a stream the first to come within the watermark's delay, of a batch the first by ts and event_id."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(key)
    first = events.groupBy(*key).agg(F.min(F.struct("ts", "event_id", *[c for c in events.columns if c not in ("ts", "event_id")])).alias("_f"))
    return first.select(*[F.col(f"_f.{c}").alias(c) for c in events.columns])


def batch_log(path: str):
    """A foreachBatch function that writes each micro-batch to its own folder of a log.

    A batch that comes again, after a failure or a restart, overwrites its own folder, so the log holds each once."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log with their batch. ``schema`` is the rows' own."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


def merged(base: DataFrame, log: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``base`` with a log's last row of each key (by batch, then ``order``) in ``columns``; keys that base lacks are added.

    The log is the change, base the last compaction: no batch rewrites the table. Rows with op = 'delete' take their key away."""
    w = F.struct("batch", *order, "op", *columns)
    last = log.groupBy(*key).agg(F.max(w).alias("_l"))
    j = base.withColumn("_old", F.lit(True)).join(last, key, "full").where("_l IS NULL OR _l.op <> 'delete'")
    new = F.col("_l").isNotNull()
    return j.select(*[F.col(x) if x in key else F.when(new, F.col(f"_l.{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in base.columns])
