"""Connected components of a graph held as an edge table: hooking to the least neighbour, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _parents(edges: DataFrame) -> DataFrame:
    """(a, m): every node with the least of itself and its neighbours. Partial sums keep hubs small."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("m")).union(edges.select("v", "u"))
    return both.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m"))


def _jump(parents: DataFrame, column: str, out: list[str]) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    p = parents.select(F.col("a").alias("_a"), F.col("m").alias("_m"))
    return cut_columns(parents, p, column, out)


def cut_columns(df: DataFrame, p: DataFrame, column: str, out: list[str]) -> DataFrame:
    joined = df.join(p, df[column] == p["_a"], "left").withColumn(column, F.coalesce("_m", column))
    return joined.select(*out)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (node, component): each node of an edge with the least node it reaches.

    Each round hooks every root to its least neighbour, halves the paths, rewrites the edges on roots and
    keeps those that still join two different roots. Edges with a null end and self loops are ignored; repeated
    edges count once; no edges give no rows. Tables are written between rounds, so a lost executor costs one round."""
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = cut(edges, "edges")
    labels = None
    while not edges.isEmpty():
        parents = cut(_parents(edges), "parents")
        parents = cut(_jump(parents, "m", ["a", "m"]), "parents")
        p = parents.select(F.col("a").alias("_a"), F.col("m").alias("_m"))
        left = cut_columns(edges, p, "u", ["u", "v"])
        left = cut_columns(left, p, "v", ["u", "v"]).where("u <> v")
        edges = cut(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        mine = parents.select(F.col("a").alias("node"), F.col("m").alias("component"))
        if labels is None:
            labels = mine
        else:
            labels = cut(cut_columns(labels, p, "component", ["node", "component"]), "labels")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
