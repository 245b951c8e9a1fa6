"""What findings of round 4 were about."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, search, source_pages
from tessera.plans import reports
from tessera.plans.fusion import two_vector_fusion
from tessera.plans.queries import SQL


def test_ranks_of_an_id_of_several_points_have_an_order(spark):
    """F1: equal scores of one id came in the order of the join; now by rank in the text list, whatever the lists' order."""
    rows = [(1, "table", v, 7, k) for v in ("text", "image") for k in range(1, 11)]
    r = random.Random(1)
    want = [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 3), (5, 3, 1), (6, 2, 2), (7, 1, 4), (8, 4, 1), (9, 2, 3), (10, 3, 2)]
    for n in range(1, 7):
        r.shuffle(rows)
        lists = spark.createDataFrame(rows, "query_id long, kind string, vector string, vec_id long, rank int").repartition(n)
        assert sorted((x.rank, x.r_text, x.r_image) for x in fusion.fused_kind(lists, "table", 10).collect()) == want


def test_fusion_of_repeated_ids_is_its_sql(spark, folder, tmp_path):
    """F1: a table with ids that several points share; the SQL has the same order of equal scores."""
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    e.union(e).union(e).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["two_vector_fusion"])
    columns = [x[0] for x in want.description]
    got = two_vector_fusion(spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert "ORDER BY score DESC, vec_id, rt, ri" in SQL["two_vector_fusion"]


def test_figures_are_looked_for_where_pages_are(spark, monkeypatch):
    """search by pages and index of numbers find the same: overlapping places, percent signs, windows' ends, keys that are null."""
    pages = [(1, 1, "R0010 111 %"), (1, 2, "11" + " " * 39 + "R0010"), (1, 3, "11" + " " * 33 + "R0010"), (1, 4, "R0010 " + "x" * 33 + "1 111 Best\u202fEstimate"), (1, 5, "\u00e9\u00e9 5.123 NaN 9 5.123,0"), (1, 6, None), (2, 1, "111 of 11"), (2, 2, "12 345.678"), (None, 1, "11")]
    pages = spark.createDataFrame(pages, "doc int, page_no int, text string")
    kinds = [("a", 11.0, None, False, 1, None), ("b", 11.0, None, True, 1, None), ("c", 1111.0, [11.0, 0.0, None], False, 2, 4), ("d", 5.123, None, False, 1, None), ("e", 12345.678, None, False, 1, None), ("f", float("nan"), None, False, 1, None), ("g", None, None, False, 1, None), ("h", 111.0, None, None, 1, None)]
    targets = spark.createDataFrame([(doc, *x) for doc in (1, 2, 3, None) for x in kinds], "doc int, kpi_name string, value double, others array<double>, is_pct boolean, page_min int, page_max int")
    anchors = spark.createDataFrame([("a", ["R0010"], []), ("b", ["%"], ["r0010"]), ("c", None, ["best estimate"]), ("x", [], [])], "kpi_name string, codes array<string>, labels array<string>")
    found = lambda **a: {(r.doc, r.kpi_name): (r.page, r.candidates, r.reason) for r in source_pages.find_pages(targets, pages, anchors, ["doc"], **a).collect()}
    got = found()
    assert len(got) == 32 and got == found(most=8)
    assert got[1, "a"] == (None, 2, "codes near on several pages") and got[1, "b"] == (1, 1, "only page") and got[1, "c"] == (4, 1, "label near")
    assert got[1, "d"] == (5, 1, "only page") and got[2, "a"] == (1, 1, "only page")
    assert got[2, "e"] == (2, 1, "only page") and got[1, "f"] == got[3, "a"] == got[None, "a"] == (None, 0, "not found")
    assert found(most=source_pages.MANY + 1) == got
    monkeypatch.setattr(source_pages, "MANY", 7)
    assert found() == got


@pytest.mark.parametrize("query", [reports.source_page_finder, reports.source_page_journal, reports.source_pages_corrected])
def test_numbers_of_pages_are_not_shuffled(spark, folder, query):
    """every number of every page was exploded, sorted and shuffled; now only lines, figures and what is found are."""
    old = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for x, v in zip(old, ("-1", "false")):
            spark.conf.set(x, v)
        plan = query(spark, folder)._jdf.queryExecution()
        physical, logical = plan.executedPlan().toString(), plan.optimizedPlan().toString()
    finally:
        for x, v in old.items():
            spark.conf.set(x, v)
    assert "posexplode" not in logical and "ahead" not in logical
    assert not any("text#" in x for x in physical.splitlines() if "Exchange" in x or "Sort " in x)
    assert physical.count("ReusedExchange") >= 2


def test_cells_of_a_search_meet_in_any_partition(spark, monkeypatch):
    """keys of a cell were int on one side and long on the other, so they met only where all partitions were put into one."""
    monkeypatch.setattr(search, "CELL_QUERIES", 10)
    monkeypatch.setattr(search, "CELL_ITEMS", 20)
    items = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    queries = items.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in search.dense_topk(queries, items, 3).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == [(q, k, 100 - k if q else k) for q in range(30) for k in (1, 2, 3)]
