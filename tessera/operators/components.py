"""Connected components by stars: a few rounds of joins, each of which halves what is left of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import checkpoints


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, component), the least node that a node is connected with; nodes without an edge don't come out.

    Rounds take turns: every node's greater neighbours are linked to its least one, then its lesser ones are. Edges never
    grow in number, chains shrink by half, and no node's neighbours are collected. Each round is written to the session's
    checkpoint folder; the driver sees its size and a checksum, and no join goes through it as a broadcast."""
    checkpoints(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = near.checkpoint()
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen = told
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
