"""Search over points of several kinds with two vectors each: filters inside every ranking, lists fused by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.search import contenders, ranked

#: Which vectors a kind of point is searched by; a kind with both has two lists that become one.
VECTORS = {"text": ["text"], "table": ["text", "image"], "image": ["image"], "sheet": ["image"]}


def ranked_lists(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, kind, vector, vec_id, score, rank): the k best points of each kind by each of its vectors.

    points: vec_id, kind, year, company, v_text, v_image; queries: query_id, q_year, q_company (null: any), q_text,
    q_image. A query's filters by year and company hold inside every list (null: any); a point without the vector of a
    list isn't in it."""
    lists = []
    for v in ("text", "image"):
        own = points.where(F.col("kind").isin(*[x for x, vs in VECTORS.items() if v in vs]) & F.col(f"v_{v}").isNotNull())
        asked = queries.select("query_id", "q_year", "q_company", F.col(f"q_{v}").alias("q"))
        found = contenders(asked, own.select("vec_id", "kind", "year", "company", F.col(f"v_{v}").alias("v")), k, ["kind"], ["year", "company"])
        lists.append(found.select("query_id", "kind", F.lit(v).alias("vector"), "vec_id", F.round("score", 6).alias("score")))
    return ranked(lists[0].union(lists[1]).where("score IS NOT NULL"), ["query_id", "kind", "vector"], k)


def fused_kind(lists: DataFrame, kind: str, k: int, constant: int = 60) -> DataFrame:
    """One list (query_id, vec_id, score, rank) of a kind from its lists by vector: both joined in full, 1 / (constant + rank) of each, k kept.

    Ties go by vec_id. An id of several points stands in a list as often and meets itself; of its equal scores the better
    rank by text comes first (either all rows of an id have that rank or none has)."""
    of = lambda v: lists.where((F.col("kind") == kind) & (F.col("vector") == v)).select("query_id", "vec_id", F.col("rank").alias(f"r_{v}"))
    one = lambda v: F.coalesce(1.0 / (constant + F.col(f"r_{v}")), F.lit(0.0))
    both = of("text").join(of("image"), ["query_id", "vec_id"], "full").withColumn("score", F.round(one("text") + one("image"), 9))
    return ranked(both.select("query_id", "vec_id", "score", "r_text", "r_image"), ["query_id"], k, tie=["vec_id", "r_text", "r_image"])


def fused(points: DataFrame, queries: DataFrame, k: int = 10, keep: int = 8, constant: int = 60) -> DataFrame:
    """The ``keep`` best over all kinds: each kind's list of k (two vectors fused into one first), then 1 / (constant + rank).

    Kinds are disjoint, so a point has one list; ties go by vec_id."""
    lists = ranked_lists(points, queries, k)
    single = lists.where(F.col("kind").isin(*[x for x, vs in VECTORS.items() if len(vs) == 1])).select("query_id", "kind", "vec_id", "rank")
    for kind in (x for x, vs in VECTORS.items() if len(vs) == 2):
        single = single.unionByName(fused_kind(lists, kind, k, constant).select("query_id", F.lit(kind).alias("kind"), "vec_id", "rank"))
    scored = single.select("query_id", "kind", "vec_id", F.col("rank").alias("list_rank"), F.round(1.0 / (constant + F.col("rank")), 9).alias("score"))
    return ranked(scored, ["query_id"], keep)


def single_collection(points: DataFrame, queries: DataFrame, kind: str, vector: str, k: int) -> DataFrame:
    """One kind by one of its vectors, with the points' own columns; any other vector is an error."""
    if vector not in VECTORS.get(kind, []):
        raise ValueError(f"{kind} has no vector {vector}")
    own = points.where(F.col("kind") == kind)
    found = ranked_lists(own, queries, k).where(F.col("vector") == vector).select("query_id", "vec_id", "score", "rank")
    return found.join(own.drop("v_text", "v_image", "kind"), "vec_id")
