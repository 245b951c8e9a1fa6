"""Reading and writing the file formats of reports and their snapshots."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoints(spark: SparkSession) -> None:
    """Uses the shared folder of ``spark.checkpoint.dir``; where that is unset, one beside the warehouse, and a temporary one only in a session on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="tessera-")).as_uri())
    else:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-checkpoints")


def written(df: DataFrame) -> DataFrame:
    """Writes ``df``, compressed, to the shared folder and reads it back: made once, however often it is read. Files go with the session's file system."""
    spark = df.sparkSession
    checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{base}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, by a stated schema: no pass over the data to infer one."""
    return spark.read.schema(schema).json(path)


def json_elements(spark: SparkSession, path: str, schema: StructType | str, field: str = "elements") -> DataFrame:
    """The rows of an array field of a JSON document."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode(field).alias("e")).select("e.*")


def semicolon_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def listed_files(spark: SparkSession, path: str, exclude: list[str] = ()) -> DataFrame:
    """Files below a folder, one of each byte size (the first by path), without excluded names. Contents aren't read."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    for part in exclude:
        found = found.where(~F.col("path").contains(part))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("length").orderBy("path"))).where("_r = 1").drop("_r")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_semicolon_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_nested(df: DataFrame, by: list[str], path: str) -> None:
    """One JSON object a group with its rows nested; groups are spread over files, none goes through the driver."""
    rest = [c for c in df.columns if c not in by]
    df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items")).write.mode("overwrite").json(path)


def replace_year(df: DataFrame, path: str) -> None:
    """Overwrites only the years that ``df`` has, in a table partitioned by year."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
