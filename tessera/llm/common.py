"""Helpers the corpus operators share: tables in the shared folder, worker paths, word counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of them, that a Python worker gets at once, at most.
ROWS_A_BATCH, BYTES_A_BATCH = 1000, 64 << 20
#: Sessions whose workers have this package.
_SHIPPED: set[str] = set()

#: Most bits of a bitmap that tells rows surely outside a set of keys.
MOST_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session; where unset, one beside the warehouse.

    A session on one machine, as in tests, gets a temporary folder instead."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = Path(tempfile.mkdtemp(prefix="tessera-")).as_uri() if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def write_shared(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` to a new folder in the shared one, and say where. It goes when the session's file system is closed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    return path


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``write_shared`` made; nothing may read it any more."""
    where, files = _place(spark, path)
    files.delete(where, True)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows doesn't depend on its lineage.

    Files go when the session's file system is closed."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, and have them get few rows at a time.

    Texts may be long: batches of ``ROWS_A_BATCH`` rows and ``BYTES_A_BATCH`` bytes bound what a worker holds, unless
    the session asks for less."""
    given = spark.conf.getAll
    for key, most in (("maxRecordsPerBatch", ROWS_A_BATCH), ("maxBytesPerBatch", BYTES_A_BATCH)):
        now = given.get(f"spark.sql.execution.arrow.{key}", "0")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def word_count(text: Column) -> Column:
    """Number of words; 0 where the text is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def may_hold(keys: DataFrame, column: str) -> Column | None:
    """A predicate on ``column``, false only for values that ``keys`` doesn't have. None if there are no keys.

    It looks into a bitmap of 8 bits a key, ``MOST_BITS`` (8 MB) at most; past that, some eight million keys, it lets
    more through, and the join that follows does all the work. The bitmap is the only thing that reaches the driver."""
    n = keys.count()
    if not n:
        return None
    bits = 1 << max(12, min(MOST_BITS, 8 * n).bit_length() - 1)
    place = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.floor(place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype="<i8")
    table[found["w"].to_numpy()] = found["b"].to_numpy()
    byte = F.conv(F.hex(F.lit(bytearray(table.tobytes())).substr(F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1
