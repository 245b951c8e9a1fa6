"""Faults that showed in ties and on larger tables."""

from pyspark.sql import functions as F

from tessera.operators import comparability, repair


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_matched_once(spark):
    """A label's words are cut once in the plan, whatever is asked of the match afterwards."""
    rows = spark.createDataFrame([(1, 0, "Branch of Old Harbour")], "table_id int, row_no int, label string")
    reference = [(f"name {i}", f"name {i}") for i in range(12)] + [("Old Harbour", "oh")]
    found = repair.matched(rows, reference)
    for plan in (plan_of(repair.flagged_labels(found)), plan_of(repair.diagnosed(found, 5))):
        assert plan.count("translate(") <= 2
    assert [tuple(r) for r in found.select("matches", "kind").collect()] == [([12], "single")]


def test_closest_in_size_among_equal_sizes(spark):
    """Of more equal sizes than are kept the least companies come, below the reference, above it and at its own."""
    rows = [("a", i, 9.0) for i in range(1, 6)] + [("a", 10, 10.0)] + [("a", 20 + i, 12.0) for i in range(3)] + [("b", 30 + i, 1.0) for i in range(6)]
    x = spark.createDataFrame(rows, "peer_group string, company_id int, size double")
    got = {(r["ref"], r["place"]): r["company_id"] for r in comparability.closest_in_size(x, x.where(F.col("company_id").isin(10, 22, 35)), 3).collect()}
    assert [got[10, p] for p in (1, 2, 3)] == [1, 2, 3]
    assert [got[22, p] for p in (1, 2, 3)] == [20, 21, 10]
    assert [got[35, p] for p in (1, 2, 3)] == [30, 31, 32]


def test_picture_clusters_broadcast_nothing(spark):
    """Neither hashes nor components are laid in the driver for a join."""
    from tessera.operators import documents

    x = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 1 << 40)], "ref long, phash long")
    found = documents.hamming_clusters(x, 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_dense_topk_in_cells(spark, monkeypatch):
    """Blocks of queries meet slices of items; copies, odd vectors and filters give what every pair scored gives."""
    import random

    from tessera.operators import fusion, search

    assert not hasattr(fusion, "passes")  # no pair of a filtered search is scored one by one
    monkeypatch.setattr(search, "CELL_QUERIES", 7)
    monkeypatch.setattr(search, "CELL_ITEMS", 20)
    monkeypatch.setattr(search, "AT_ONCE", 4)
    r = random.Random(5)
    vectors = [[r.choice([0.0, 0.5, 1.0, r.random()]) for _ in range(4)] for _ in range(25)]
    rows = [(i, vectors[i % 25], "ab"[i % 2], 2020 + i % 3 if i % 4 else None) for i in range(90)]
    rows += [(90, [1.0, None, 1.0, 1.0], "a", 2020), (91, None, "b", 2021), (92, [1.0, float("nan"), 0.0, 0.0], "a", 2022), (93, [], "a", 2020)]
    items = spark.createDataFrame(rows, "vec_id long, v array<double>, kind string, year int")
    queries = items.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.when(F.col("vec_id") % 2 == 0, F.col("year")).alias("q_year"))
    pairs = queries.crossJoin(items).where("query_id <> vec_id").withColumn("score", F.round(search.dot(F.col("q"), F.col("v")), 6))
    told = lambda x, *c: sorted((str(tuple(row)) for row in x.select(*c).where("score IS NOT NULL").collect()))
    want = search.ranked(pairs, ["query_id"], 5)
    assert told(search.dense_topk(queries, items, 5), "query_id", "vec_id", "score", "rank") == told(want, "query_id", "vec_id", "score", "rank")
    want = search.ranked(pairs.where("q_year IS NULL OR q_year = year"), ["query_id", "kind"], 3)
    got = search.ranked(search.contenders(queries, items, 3, ["kind"], ["year"]).withColumn("score", F.round("score", 6)), ["query_id", "kind"], 3)
    assert told(got, "query_id", "kind", "vec_id", "score", "rank") == told(want, "query_id", "kind", "vec_id", "score", "rank")
