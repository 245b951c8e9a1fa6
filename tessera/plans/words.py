"""Queries on pages of words with places, printed from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import words
from tessera.plans.queries import c, query
from tessera.session import table

COLUMNS = ["C0010", "C0020", "C0030", "C0060"]
ROWS = [f"R{i:04d}" for i in range(10, 80, 10)]


def page_words(spark, d) -> DataFrame:
    """A page an order: column codes above (and one lower), a row of each line with a figure in pieces; copies a little off, in chains."""
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("n"), c("l_quantity").cast("long").alias("q"), F.floor(c("l_extendedprice")).cast("long").alias("v"), F.floor(c("l_discount") * 100 + 0.5).cast("long").alias("disc"))
    row = 40.0 + 20 * c("n")
    box = lambda x, y, text, wide=16.0: F.struct(F.lit(x).cast("double").alias("x0") if not hasattr(x, "alias") else x.cast("double").alias("x0"), (y if hasattr(y, "alias") else F.lit(y)).cast("double").alias("y0"), text.alias("text"), F.lit(wide).alias("w"))
    column = 100.0 * (c("q") % 3 + 2)
    lift = F.when(c("disc") == 4, -6.0).otherwise(0.5)
    mine = [
        box(20.0, row, F.concat(F.lit("R"), F.lpad((c("n") * 10).cast("string"), 4, "0"))),
        box(column, row + lift, F.floor(c("v") / 1000).cast("string")),
        box(column + 19, row + lift, F.lpad((c("v") % 1000).cast("string"), 3, "0")),
        F.when(c("disc") > 7, box(column + 130, row, F.concat(c("disc").cast("string"), F.lit("%")))),
        F.when(c("disc") == 5, box(20.0, row + 200, F.concat(F.lit("R"), F.lpad((c("n") * 10).cast("string"), 4, "0")))),
    ]
    body = li.select("page", "q", "disc", F.explode(F.array_compact(F.array(*mine))).alias("b")).select("page", "q", "disc", "b.*")
    order = li.select("page").distinct().where("page % 7 <> 0")
    heads = F.explode(F.array(*[box(100.0 * (i + 2) + (10 if i < 3 else -180), 10.0 if i < 3 else 90.0, F.lit(x)) for i, x in enumerate(COLUMNS)], box(20.0, 4.0, F.lit("R0010"))))
    top = order.select("page", F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("disc"), heads.alias("b")).select("page", "q", "disc", "b.*")
    every = body.unionByName(top)
    shifts = F.when(c("q") % 4 == 1, F.array(F.lit(0.0), F.lit(0.375))).when(c("q") % 4 == 2, F.array(F.lit(0.0), F.lit(0.75), F.lit(1.5), F.lit(2.25))).otherwise(F.array(F.lit(0.0)))
    copies = every.withColumn("s", F.explode(shifts))
    return copies.select("page", (c("x0") + c("s")).alias("x0"), c("y0").alias("y0"), (c("x0") + c("s") + c("w")).alias("x1"), (c("y0") + 10).alias("y1"), "text")


_WORDS = """li AS (SELECT l_orderkey AS page, l_linenumber AS n, l_quantity::BIGINT AS q, floor(l_extendedprice)::BIGINT AS v, floor(l_discount * 100 + 0.5)::BIGINT AS disc, 40.0::DOUBLE + 20 * l_linenumber AS row, 100.0::DOUBLE * (l_quantity::BIGINT % 3 + 2) AS col FROM lineitem),
bx AS (SELECT page, q, 20.0::DOUBLE AS x, row AS y, 'R' || lpad((n * 10)::VARCHAR, 4, '0') AS text FROM li UNION ALL SELECT page, q, col, row + CASE WHEN disc = 4 THEN -6.0 ELSE 0.5 END, (v // 1000)::VARCHAR FROM li
  UNION ALL SELECT page, q, col + 19, row + CASE WHEN disc = 4 THEN -6.0 ELSE 0.5 END, lpad((v % 1000)::VARCHAR, 3, '0') FROM li UNION ALL SELECT page, q, col + 130, row, disc || '%' FROM li WHERE disc > 7
  UNION ALL SELECT page, q, 20.0, row + 200, 'R' || lpad((n * 10)::VARCHAR, 4, '0') FROM li WHERE disc = 5
  UNION ALL SELECT page, 0, x, y, text FROM (SELECT DISTINCT page FROM li WHERE page % 7 <> 0), (VALUES (210.0, 10.0, 'C0010'), (310.0, 10.0, 'C0020'), (410.0, 10.0, 'C0030'), (320.0, 90.0, 'C0060'), (20.0, 4.0, 'R0010')) v(x, y, text)),
wd AS (SELECT page, x + s AS x0, y AS y0, x + s + 16 AS x1, y + 10 AS y1, text FROM (SELECT *, unnest(CASE WHEN q % 4 = 1 THEN [0.0, 0.375] WHEN q % 4 = 2 THEN [0.0, 0.75, 1.5, 2.25] ELSE [0.0] END)::DOUBLE AS s FROM bx)),
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page, text ORDER BY y0, x0, x1, y1) AS i FROM wd),
rc AS (SELECT page, text, i, [{'x': x0, 'y': y0}] AS seeds, 1 AS seed FROM od WHERE i = 1
  UNION ALL SELECT page, text, i, CASE WHEN hit IS NULL THEN list_append(seeds, {'x': x0, 'y': y0}) ELSE seeds END, coalesce(hit, len(seeds) + 1) FROM (
    SELECT o.page, o.text, o.i, o.x0, o.y0, rc.seeds, nullif(list_position([abs(o.x0 - s.x) <= 1 AND abs(o.y0 - s.y) <= 1 FOR s IN rc.seeds], true), 0) AS hit FROM rc JOIN od o ON o.page = rc.page AND o.text = rc.text AND o.i = rc.i + 1)),
dd AS MATERIALIZED (SELECT page, text, sum(x0) / count(*) AS x0, sum(y0) / count(*) AS y0, sum(x1) / count(*) AS x1, sum(y1) / count(*) AS y1, count(*) AS copies FROM od JOIN rc USING (page, text, i) GROUP BY page, text, seed)"""
_R = lambda x: f"round({x}, 6) AS {x}"


@query(f"WITH RECURSIVE {_WORDS} SELECT page, {', '.join(map(_R, words.BOX))}, text, copies FROM dd")
def duplicate_words(spark, d):
    x = words.deduplicated(page_words(spark, d), ["page"])
    # a multiple of 1/64 has six decimals at most, and stays as it is
    rounded = [F.when(c(b) * 64 == F.rint(c(b) * 64), c(b)).otherwise(F.round(b, 6)).alias(b) for b in words.BOX]
    return x.select("page", *rounded, "text", "copies")


_CELLS = """hd AS (SELECT page, text AS col_code, arg_max((x0 + x1) / 2, (y0, x0, x1)) AS centre, min(y1) AS y1 FROM dd WHERE regexp_matches(text, '^C\\d{4}$') GROUP BY ALL), bd AS (SELECT page, min(y1) AS top FROM hd GROUP BY 1),
rw AS (SELECT page, text AS row_code, arg_min({'y': y0, 'x': x1}, (y0, x0, x1)) AS r FROM dd LEFT JOIN bd USING (page) WHERE regexp_matches(text, '^R\\d{4}$') AND y0 > coalesce(top, 0) GROUP BY ALL),
mt AS (SELECT page, row_code, x0, x1, text, abs(y0 - r.y) <= 1.5 AS level FROM rw JOIN dd USING (page) WHERE regexp_matches(text, '^[-+(]?\\d[\\d.,]*%?\\)?$|^-$') AND x0 > r.x AND y0 - r.y <= 1.5 AND r.y - y0 <= 10),
mk AS (SELECT * FROM mt QUALIFY level = max(level) OVER (PARTITION BY page, row_code)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY page, row_code ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page, row_code ORDER BY x0, x1, text) > 5, true)::INT AS new FROM mk)),
mg AS (SELECT page, row_code, run, string_agg(text, '' ORDER BY x0, x1, text) AS value, (min(x0) + max(x1)) / 2 AS spot FROM rn GROUP BY ALL),
pl AS (SELECT page, row_code, run, value, arg_min(col_code, (abs(centre - spot), col_code)) AS col_code FROM mg JOIN hd USING (page) GROUP BY ALL),
ce AS (SELECT page, row_code, col_code, arg_max(value, run) AS value FROM pl GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_WORDS}, {_CELLS} SELECT page, row_code, col_code, value FROM rw LEFT JOIN ce USING (page, row_code)")
def table_cells(spark, d):
    return words.native_cells(page_words(spark, d), ["page"], COLUMNS, near=1.0)


@query(f"WITH RECURSIVE {_WORDS}, {_CELLS}, pc AS (SELECT page, list_sort(list_distinct(list(row_code))) AS f FROM rw GROUP BY 1) SELECT page, 7 AS n_expected, len(f)::INT AS n_found, array_to_string(list_filter({ROWS}, lambda x: NOT list_contains(f, x)), ',') AS missing, array_to_string(list_filter(f, lambda x: NOT list_contains({ROWS}, x)), ',') AS unexpected FROM pc")
def table_completeness(spark, d):
    return words.completeness(words.native_rows(page_words(spark, d), ["page"], near=1.0), ["page"], ROWS)


@query(f"WITH RECURSIVE {_WORDS}, {_CELLS}, ct AS (SELECT page // 5 AS sheet, page, count(value) AS n FROM rw LEFT JOIN ce USING (page, row_code) GROUP BY ALL), cw AS (SELECT *, count(*) FILTER (n > 0) OVER (PARTITION BY sheet) AS filled_pages, min(page) FILTER (n > 0) OVER (PARTITION BY sheet) AS first_filled FROM ct) SELECT sheet, page, filled_pages, first_filled FROM cw WHERE n = 0 AND filled_pages > 0")
def empty_pages_suspected(spark, d):
    """Five pages are a sheet."""
    counts = table_cells(spark, d).groupBy(F.floor(c("page") / 5).alias("sheet"), "page").agg(F.count("value").alias("n"))
    return words.empty_suspects(counts, ["sheet"], "page")
