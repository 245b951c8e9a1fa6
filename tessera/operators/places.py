"""Joins by place: ranges, nearest neighbours and bands, each through buckets so that only near rows meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import best_first


#: Points, and ranges, of a bucket that meet in one cell.
CELL = 4096


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges that hold them, both ends included. A range is dealt to the buckets of ``width`` it touches.

    A bucket's points and ranges are dealt into slices of some ``CELL`` by their hash, and each slice of points meets each
    of ranges in a cell of its own, so that a bucket that holds much is many small groups. Sides are merged, not broadcast,
    for few input files would leave all pairs to few tasks."""
    bucket = lambda c: F.floor(F.col(c) / width)
    left = points.withColumn("_b", bucket(point))
    right = ranges.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    key = [*by, "_b"]
    slices = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / CELL).alias(name))
    sizes = slices(left, "_m").join(slices(right, "_n"), key)
    dealt = lambda rows, own, other, mine, theirs: rows.withColumn("_h", F.xxhash64(*rows.columns)).join(sizes, key).withColumn(own, F.pmod("_h", mine)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1))).drop("_h", "_m", "_n")
    cells = [*key, "_i", "_j"]
    met = dealt(left, "_i", "_j", "_m", "_n").join(dealt(right, "_j", "_i", "_n", "_m").hint("merge"), cells)
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b", "_i", "_j")


def nearest(values: DataFrame, targets: DataFrame, by: list[str], x: str, tx: str, key: list[str], tie: str) -> DataFrame:
    """Each value with the target of its page that is nearest along x; ties by ``tie``. A page's targets are a table's columns."""
    pairs = values.join(targets, by).withColumn("gap", F.round(F.abs(F.col(x) - F.col(tx)), 6))
    return best_first(pairs, key, F.col("gap"), F.col(tie))


def band_with_fallback(codes: DataFrame, values: DataFrame, by: list[str], key: list[str], strict: Column, loose: Column, width: float, y: str, vy: str) -> DataFrame:
    """Codes with the values in their band; codes without any are tried again in the looser band.

    Bands are dealt to buckets of ``width`` (no less than half a loose band), so a row meets its own and two others."""
    left = codes.withColumn("_b", F.explode(F.array(*[F.floor(F.col(y) / width) + d for d in (-1, 0, 1)])))
    pairs = left.join(values.withColumn("_b", F.floor(F.col(vy) / width)), [*by, "_b"]).drop("_b")
    near = pairs.where(strict | loose)
    first = near.where(strict).withColumn("band", F.lit("strict"))
    rest = near.where(loose).join(first.select(*key).distinct(), key, "left_anti").withColumn("band", F.lit("loose"))
    return first.unionByName(rest)


def prefix_join(variants: DataFrame, names: DataFrame, prefix: str, name: str, lengths: list[int]) -> DataFrame:
    """Names with the variants they start with: an equi-join on each length that prefixes have."""
    keyed = names.withColumn("_k", F.explode(F.array_distinct(F.array(*[F.substring(F.col(name), 1, n) for n in lengths]))))
    return keyed.join(variants, keyed["_k"] == variants[prefix]).drop("_k")
