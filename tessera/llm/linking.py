"""From buckets of alike items to components, with every candidate confirmed and no pair lost to a bucket's size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.components import components

#: Buckets up to so many members are compared pair by pair, larger ones block by block.
SMALL = 24
#: Members of a block. A task compares two blocks.
BLOCK = 512


def scored(keys: DataFrame) -> DataFrame:
    """(bucket, node) of buckets with two members or more, with score: the sizes of a node's buckets, summed.

    In a group of copies the original, or what is nearest to it, shares most buckets."""
    sizes = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    buckets = cut(keys.join(sizes, "bucket"), "buckets")
    return cut(buckets.select("bucket", "node").join(buckets.groupBy("node").agg(F.sum("n").alias("score")), "node"), "scored")


def with_leaders(keys: DataFrame) -> DataFrame:
    """(bucket, node), each once, to (bucket, node, n, a, b) of buckets with two members or more.

    n is the bucket's size, a and b are its leaders: with a column score the member of greatest score and one by hash,
    else the least and the greatest node. They come from partial aggregates and meet the members in a join, so a large
    bucket is never one task's."""
    if "score" in keys.columns:
        first, other = F.struct(-F.col("score"), F.xxhash64("node"), "node"), F.struct(F.xxhash64("node", "bucket"), "node")
        leaders = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min(first)["node"].alias("a"), F.min(other)["node"].alias("b"))
    else:
        leaders = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    leaders = cut(leaders.where("n > 1"), "leaders")
    return cut(keys.select("bucket", "node").join(leaders, "bucket"), "held")


def leader_pairs(held: DataFrame) -> DataFrame:
    """(u, v): each member of a bucket with its two leaders."""
    pairs = held.select("node", F.explode(F.array_distinct(F.array("a", "b"))).alias("_l")).where("node <> _l")
    return pairs.select(F.least("node", "_l").alias("u"), F.greatest("node", "_l").alias("v")).distinct()


def mixed_members(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, comp, main, n, f) of buckets that span several components: n members, f of those here outside ``main``.

    ``main`` is the first leader's component. Its members need no comparing with one another; every other member meets
    all the rest but for the two leaders, with whom all members have been compared."""
    own, lead = labels.toDF("node", "_c"), labels.toDF("a", "_m")
    named = held.where("n > 3 AND node <> a AND node <> b").select("bucket", "node", "n", "a").join(own, "node", "left").join(lead, "a", "left")
    named = cut(named.select("bucket", "node", F.coalesce("_c", "node").alias("comp"), F.coalesce("_m", "a").alias("main"), "n"), "named")
    outside = cut(named.where("comp <> main").groupBy("bucket").agg(F.count("*").alias("f")), "outside")
    return cut(named.join(outside, "bucket"), "members")


def rest_pairs(members: DataFrame) -> DataFrame:
    """(u, v): the pairs of a bucket whose ends aren't in one component yet."""
    foreign = members.where("comp <> main").select("bucket", F.col("node").alias("_f"), F.col("comp").alias("_c"))
    met = (F.col("comp") != F.col("_c")) & ((F.col("comp") == F.col("main")) | (F.col("_f") < F.col("node")))
    pairs = members.join(foreign, "bucket").where(met)
    return pairs.select(F.least("node", "_f").alias("u"), F.greatest("node", "_f").alias("v")).distinct()


def rest_blocks(members: DataFrame) -> DataFrame:
    """(bucket, i, j, node, comp, guest): the members of a large bucket dealt to tasks (i, j).

    A task holds one block of all members and, as guests, one of those outside the main component; so each of
    these meets every member once, and a bucket of any size is as many tasks as it has pairs of blocks."""
    blocks = members.withColumn("_n", F.ceil(F.col("n") / BLOCK)).withColumn("_f", F.ceil(F.col("f") / BLOCK)).withColumn("_h", F.xxhash64("node", F.lit(7)))
    hosts = blocks.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_f") - 1)).alias("i"), F.pmod("_h", "_n").alias("j"), "node", "comp", F.lit(False).alias("guest"))
    outside = blocks.where("comp <> main")
    guests = outside.select("bucket", F.pmod("_h", "_f").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("j"), "node", "comp", F.lit(True).alias("guest"))
    return hosts.union(guests)


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Edges (u, v) of a spanning forest of the links a-b."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist() if len(a) else []:
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return pd.DataFrame(kept, columns=["u", "v"], dtype="int64")


def link(held: DataFrame, confirm: Callable[[DataFrame], DataFrame], confirm_blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``with_leaders`` gives to (node, component) of the nodes that have a confirmed link.

    ``confirm`` takes candidate pairs (u < v, each once) and returns those that hold. First each member is compared
    with its buckets' leaders; then, in buckets that still span several components, every pair across components:
    pair by pair, or, where the bucket is large, by ``confirm_blocks``, block by block without any pairs in a
    shuffle. So each pair that shares a bucket is confirmed unless confirmed links already join it, at a cost that
    is linear for a bucket of copies of one text. Nulls aren't expected; repeated rows count once."""
    labels = components(cut(confirm(leader_pairs(held)), "links"))
    members = mixed_members(held, labels)
    more = confirm(rest_pairs(members.where(F.col("n") <= SMALL)))
    large = members.where(F.col("n") > SMALL)
    if not large.isEmpty():
        more = more.union(confirm_blocks(rest_blocks(large)))
    more = cut(more, "links")
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
