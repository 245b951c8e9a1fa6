"""Queries of filtered searches over several kinds of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fusion
from tessera.plans.queries import c, query
from tessera.session import table


def points(spark, d) -> DataFrame:
    """Embeddings as points: kind by label, year and company by id, halves of the vector as its two vectors; some lack one."""
    e = table(spark, d, "embeddings")
    kind = F.element_at(F.array(*[F.lit(x) for x in fusion.VECTORS]), (c("label") % 4 + 1).cast("int"))
    half = lambda at: F.slice("embedding", at, 32)
    return e.select("vec_id", kind.alias("kind"), (2020 + c("vec_id") % 3).cast("int").alias("year"), F.format_string("company %d", c("vec_id") % 5).alias("company"), half(1).alias("v_text"), F.when(c("vec_id") % 13 != 0, half(33)).alias("v_image"))


def questions(spark, d) -> DataFrame:
    """Every twentieth vector asks: of any point, of its year, of its company, of both."""
    e = table(spark, d, "embeddings").where("vec_id % 20 = 0")
    turn = (c("vec_id") / 20).cast("long") % 4
    half = lambda at: F.slice("embedding", at, 32)
    return e.select(c("vec_id").alias("query_id"), F.when(turn % 2 == 1, (2020 + c("vec_id") % 3).cast("int")).alias("q_year"), F.when(turn >= 2, F.format_string("company %d", (c("vec_id") / 20).cast("long") % 5)).alias("q_company"), half(1).alias("q_text"), half(33).alias("q_image"))


_DOT = lambda a, b: f"round(list_sum([z[1]::DOUBLE * z[2]::DOUBLE FOR z IN list_zip({a}, {b})]), 6)"
_SQL = f"""pt AS (SELECT vec_id, ['text', 'table', 'image', 'sheet'][label % 4 + 1] AS kind, (2020 + vec_id % 3)::INT AS year, 'company ' || vec_id % 5 AS company, embedding[1:32] AS vt, CASE WHEN vec_id % 13 <> 0 THEN embedding[33:64] END AS vi FROM embeddings),
qs AS (SELECT vec_id AS query_id, CASE WHEN vec_id // 20 % 2 = 1 THEN 2020 + vec_id % 3 END AS qy, CASE WHEN vec_id // 20 % 4 >= 2 THEN 'company ' || vec_id // 20 % 5 END AS qc, embedding[1:32] AS qt, embedding[33:64] AS qi FROM embeddings WHERE vec_id % 20 = 0),
pr AS (SELECT * FROM qs JOIN pt ON query_id <> vec_id AND (qy IS NULL OR qy = year) AND (qc IS NULL OR qc = company)),
ls AS (SELECT query_id, kind, vector, vec_id, score, row_number() OVER (PARTITION BY query_id, kind, vector ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT query_id, kind, 'text' AS vector, vec_id, {_DOT('qt', 'vt')} AS score FROM pr WHERE kind IN ('text', 'table')
  UNION ALL SELECT query_id, kind, 'image', vec_id, {_DOT('qi', 'vi')} FROM pr WHERE kind <> 'text' AND vi IS NOT NULL) QUALIFY rank <= 10),
tb AS (SELECT query_id, vec_id, round(coalesce(1.0::DOUBLE / (60 + rt), 0) + coalesce(1.0::DOUBLE / (60 + ri), 0), 9) AS score, rt, ri FROM (SELECT query_id, vec_id, rank AS rt FROM ls WHERE kind = 'table' AND vector = 'text') FULL JOIN (SELECT query_id, vec_id, rank AS ri FROM ls WHERE kind = 'table' AND vector = 'image') USING (query_id, vec_id)),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, rt, ri) AS rank FROM tb QUALIFY rank <= 10),
al AS (SELECT query_id, kind, vec_id, rank AS list_rank FROM ls WHERE kind <> 'table' UNION ALL SELECT query_id, 'table', vec_id, rank FROM tr),
fu AS (SELECT *, round(1.0::DOUBLE / (60 + list_rank), 9) AS score FROM al)"""


@query(f"WITH {_SQL} SELECT query_id, vec_id, score, rt AS r_text, ri AS r_image, rank FROM tr")
def two_vector_fusion(spark, d):
    return fusion.fused_kind(fusion.ranked_lists(points(spark, d), questions(spark, d), 10), "table", 10)


@query(f"WITH {_SQL} SELECT query_id, kind, vec_id, list_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fu QUALIFY rank <= 8")
def filtered_fusion(spark, d):
    return fusion.fused(points(spark, d), questions(spark, d))


@query(f"WITH {_SQL} SELECT query_id, vec_id, score, rank, year, company FROM ls JOIN pt USING (vec_id, kind) WHERE kind = 'table' AND vector = 'image' AND rank <= 5")
def collection_search(spark, d):
    return fusion.single_collection(points(spark, d), questions(spark, d), "table", "image", 5)
