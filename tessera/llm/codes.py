"""Vector codes by Lloyd's rounds in integers, whose sums are kept up by the parts that change their entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, remove_shared, ship, write_shared

#: Scaled components beyond these count as these, so that all sums stay whole numbers of 64 bits.
GREATEST = 1 << 26
#: Labels with a greater share of the rows than one in so many are few and get their sum by broadcast.
HOT_SHARE = 256


@dataclass
class Compressed:
    """codes: (vec_id, label, code binary with one byte a part, error); codebooks: part, entry, component."""

    codes: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, with commas between them."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        """(part, entry, components), one row an entry."""
        rows = [(p, e, entry.tolist()) for p, part in enumerate(self.codebooks) for e, entry in enumerate(part)]
        return spark.createDataFrame(rows, "part int, entry int, components array<long>")


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows whose vector has only finite components, as vec_id, label, v: the floor of ``scale`` times each component."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-GREATEST)), F.least(F.lit(float(GREATEST)), c * scale))).cast("int"))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def nearest(v: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part of each vector (rows, parts, width), the lower one of equals, and its squared distance; exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(codebooks).max(initial=0)))
    kind = np.float64 if 4 * v.shape[2] * most * most < 2**53 else np.int64  # whole numbers below 2^53 are exact in either
    a, b = v.astype(kind).transpose(1, 0, 2), codebooks.astype(kind)
    distance = (a * a).sum(2)[:, :, None] - 2 * (a @ b.transpose(0, 2, 1)) + (b * b).sum(2)[:, None, :]
    entry = distance.argmin(2)
    return entry.T, np.take_along_axis(distance, entry[:, :, None], 2)[:, :, 0].T.astype(np.int64)


def _assigned(state: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Rows with ``was`` (the code before), code and error by these codebooks."""
    parts, _, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = np.zeros((n, parts * width), dtype=np.int64)
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            v[np.arange(parts * width)[None, :] < lengths[:, None]] = batch.column("v").flatten().to_numpy()
            entry, distance = nearest(v.reshape(n, parts, width), codebooks)
            code = pa.array([row.tobytes() for row in entry.astype(np.uint8)], pa.binary())
            error = pa.array(distance.sum(1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), batch.column("code"), code, error], names=["vec_id", "label", "v", "was", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.select("vec_id", "label", "v", "code").mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, was binary, code binary, error long")


def _changes(state: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, sums): what parts take from the entry they left and bring to the one they joined."""
    entry = lambda code, p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    moves = []
    for p in range(parts):
        own = F.slice("v", p * width + 1, width)
        for sign, code in ((-1, "was"), (1, "code")):
            moves.append(F.when(F.col(code).isNotNull() & ~entry("was", p).eqNullSafe(entry("code", p)), F.struct(F.lit(p).alias("part"), entry(code, p).alias("entry"), F.lit(sign).alias("sign"), own.alias("v"))))
    changed = state.where(~F.col("was").eqNullSafe(F.col("code"))).select(F.explode(F.array_compact(F.array(*moves))).alias("m")).select("m.*")
    here = [F.sum(F.col("sign") * F.coalesce(F.get("v", F.lit(i)), F.lit(0)).cast("long")).alias(f"x{i}") for i in range(width)]
    return changed.groupBy("part", "entry").agg(F.sum(F.col("sign").cast("long")).alias("n"), *here)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed:
    """(vec_id, embedding, label) to codes of ``parts`` bytes and the codebooks they refer to.

    Vectors that are null or hold null or non-finite components are left out. Components become floor(scale * x), at
    most ``GREATEST`` either way; vectors are cut into equal parts, shorter ones (and lengths that don't divide) go on
    with zeros. Each part's codebook starts as that part of the ``entries`` least vec_ids (null last, equal ones by
    vector; fewer if there are fewer rows). A round assigns all parts to their nearest entry (ties: the lower) and moves
    each entry to the floor of its parts' mean; unused ones stay. Codes and errors are by the final codebooks.

    A round's assignments and the running sums are written; only parts that changed their entry are summed and
    shuffled, as plus and minus. A round that moves no entry ends the rounds, as none after it would. The driver holds
    the codebooks only, whose size is parts * entries * width. Repeated and null ids are rows of their own; other
    columns are ignored; an empty table gives no codes."""
    spark = vectors.sparkSession
    ship(spark)
    state = cut(scaled(vectors, scale), "scaled")
    length = state.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-length // parts))
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = np.zeros((parts, max(1, len(first)), width), dtype=np.int64)
    for e, row in enumerate(first):
        whole = np.zeros(parts * width, dtype=np.int64)
        whole[: len(row.v)] = row.v
        codebooks[:, e] = whole.reshape(parts, width)
    columns = ["n", *[f"x{i}" for i in range(width)]]
    sums = spark.createDataFrame([], ", ".join(["part int", "entry int", *[f"{c} long" for c in columns]]))
    state, before = state.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        path = write_shared(_assigned(state, codebooks), "assigned")
        if before:
            remove_shared(spark, before)
        state, before = spark.read.parquet(path), path
        sums = cut(sums.union(_changes(state, parts, width)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns]).coalesce(1), "sums")
        held = sums.where("n > 0").toArrow()
        old = codebooks.copy()
        if held.num_rows:
            total = np.stack([held[c].to_numpy() for c in columns[1:]], axis=1)
            codebooks[held["part"].to_numpy(), held["entry"].to_numpy()] = total // held["n"].to_numpy()[:, None]
        if (old == codebooks).all():
            break
    codes = cut(_assigned(state, codebooks).select("vec_id", "label", "code", "error"), "codes")
    if before:
        remove_shared(spark, before)
    return Compressed(codes, codebooks)


def decompressed(codes: DataFrame, codebooks: DataFrame, parts: int) -> DataFrame:
    """(vec_id, code) to (vec_id, v): the entries that a code names, put together again. ``codebooks`` is Compressed.table()."""
    entry = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    book = codebooks.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("entry", "components"))).alias("e"))
    whole = book.agg(F.sort_array(F.collect_list(F.struct("part", "e"))).alias("books"))  # one row, of the codebooks' size
    found = [F.get(F.get("books", F.lit(p))["e"], entry(p))["components"] for p in range(parts)]
    return codes.crossJoin(F.broadcast(whole)).select("vec_id", F.concat(*found).alias("v"))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: the errors of the label's rows (rows without label are one label), summed.

    Labels that hold more than 1 / ``HOT_SHARE`` of the rows, fewer than ``HOT_SHARE`` of them, are joined by broadcast; the rest by shuffle, where no label is a large part."""
    per = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    rows = per.agg(F.sum("_n")).first()[0] or 0
    hot = per.where(F.col("_n") * HOT_SHARE > rows).select(F.col("label").alias("_hot"), F.col("label_error").alias("_sum"), F.lit(True).alias("_is_hot"))
    told = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_hot")), "left").drop("_hot")
    rest = per.where(F.col("_n") * HOT_SHARE <= rows).select(F.col("label").alias("_label"), "label_error")
    cold = told.where("_is_hot IS NULL").join(rest, F.col("label").eqNullSafe(F.col("_label")))
    return told.where("_is_hot").select(*codes.columns, F.col("_sum").alias("label_error")).union(cold.select(*codes.columns, "label_error"))
