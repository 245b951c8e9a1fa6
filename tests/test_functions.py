"""Functions and operators on small tables, against results worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import documents, indicators, ordering, search, warehouse
from tessera.sources import files


@pytest.mark.parametrize(
    "raw,value",
    [("2160259", 2160259.0), ("2,74", 2.74), ("521%", 5.21), ("-", 0.0), ("(10 475 550)", -10475550.0), ("- 12", -12.0), ("1 234 567", 1234567.0), ("R0210", None), ("", None), (None, None)],
)
def test_parse_number(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(numbers.parse_number(F.col("x"))).first()[0] == value


@pytest.mark.parametrize("raw,good", [("12", True), ("(1 234)", True), ("-5,2%", True), ("-", True), ("(Diversification", False), ("year)", False), ("-life", False), ("(", False), (")", False)])
def test_fragments(spark, raw, good):
    assert spark.createDataFrame([(raw,)], "x string").select(numbers.is_fragment(F.col("x"))).first()[0] is good


@pytest.mark.parametrize("raw,value,digits", [("1.234.567", 1234567.0, 0), ("(1 234)", 1234.0, 0), ("0,5", 0.5, 1), ("R0210", None, None)])
def test_amounts(spark, raw, value, digits):
    a, b = numbers.parse_amount(F.col("x"))
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(a.alias("a"), b.alias("b")).first()) == (value, digits)


def test_formats(spark):
    df = spark.createDataFrame([(1234567.891,), (-2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(numbers.printed(F.col("v"))).collect()] == ["1 234 567,9", "−2,5", None]
    assert [r[0] for r in df.select(numbers.csv_number(F.col("v"))).collect()] == ["1234567,891", "-2,5", ""]


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    got = spark.createDataFrame([("a",), ("é b",)], "x string").select(numbers.uuid5(str(space), F.col("x"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(space, x)) for x in ("a", "é b")]


def test_text(spark):
    df = spark.createDataFrame([("SCR and scr. See [Article 12] and [Article 3].",)], "t string")
    first = df.select(text.expand_first(F.col("t"), [("scr", "requirement")]).alias("e"), text.citations(F.col("t")).alias("c")).first()
    assert first.e.startswith("SCR (requirement) and scr.") and first.c == [12, 3]
    levels = spark.createDataFrame([("B.1.2 Title",), ("Title",), ("A Heading",)], "t string").select(text.title_level(F.col("t"))).collect()
    assert [r[0] for r in levels] == [3, None, 1]
    broken = spark.createDataFrame([("the infor ma tion of us",)], "t string").select(text.broken_words(F.col("t"), ["of", "us", "the"])).first()[0]
    assert broken == ["infor ma"]


def test_heading_path_and_spans(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, 3, "C"), (1, 3, 2, "D"), (1, 4, 1, "E"), (1, 5, 3, "F")]
    df = spark.createDataFrame(rows, "doc int, pos int, level int, title string").withColumn("end", F.lit(9))
    out = ordering.heading_path(ordering.subtree_span(df, ["doc"], "pos", "level", "end"), ["doc"], "pos", "level", "title").orderBy("pos").collect()
    assert [r.path for r in out] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]
    assert [r.subtree_end for r in out] == [4, 3, 3, 4, 9, 9]


def test_greedy_groups(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([200, 250, 100, 600, 10, 20])], "doc int, pos int, n int")
    got = [tuple(r)[2:] for r in ordering.greedy_groups(df, ["doc"], "pos", "n", 400, 500).orderBy("group").collect()]
    assert got == [(0, 1, 450), (2, 3, 700), (4, 5, 30)]


def test_total_excluded(spark):
    rows = [("pair", 5.0), ("pair", 5.0), ("total", 1.0), ("total", 2.0), ("total", 3.0), ("plain", 1.0), ("plain", 7.0), ("zero", 0.0), ("zero", 0.0)]
    got = {r.k: (r.total, r.excluded) for r in indicators.total_excluded_sum(spark.createDataFrame(rows, "k string, value double"), ["k"], 0.001).collect()}
    assert got == {"pair": (10.0, False), "total": (3.0, True), "plain": (8.0, False), "zero": (0.0, False)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "k int, v string, flag boolean")
    new = spark.createDataFrame([(2, "B", False), (3, "c", False)], "k int, v string, flag boolean")
    once = warehouse.upsert(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", True), (2, "B", True), (3, "c", False)]
    assert warehouse.changed(once, warehouse.upsert(once, new, ["k"], ["v"]), ["k"]).isEmpty()


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "l int, score double")
    assert sorted((r.l, r.norm) for r in search.min_max(df, ["l"]).collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_picture_clusters(spark):
    files.checkpoints(spark)
    rows = [(1, 0), (2, 1), (3, 0b11), (4, 0), (5, (1 << 40) - 1), (6, (1 << 40) - 2)]
    got = {r.ref: r.canonical for r in documents.hamming_clusters(spark.createDataFrame(rows, "ref long, phash long"), 1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


def test_triage_and_continuation(spark):
    rows = [("d", 1, "Table of contents"), ("d", 2, "S.02.01 Balance"), ("d", 3, "words"), ("d", 4, "S.02.01 S.05.01 S.23.01"), ("d", 5, "words")]
    out = documents.continued(documents.triage(spark.createDataFrame(rows, "page_key string, page_no int, text string"))).orderBy("page_no").collect()
    assert [r.kind for r in out] == ["contents", "table", "narrative", "index", "narrative"]
    assert [r.effective_template for r in out] == [None, "S.02.01", "S.02.01", None, None]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, "x"), (2, 2021, "y;z")], "id int, year int, t string")
    files.write_json_lines(df, f"{tmp_path}/j")
    assert sorted(map(tuple, files.json_lines(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(tuple, df.collect()))
    files.write_semicolon_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, files.semicolon_csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(map(tuple, df.collect()))
    files.replace_year(df, f"{tmp_path}/p")
    files.replace_year(df.where("year = 2021").withColumn("t", F.lit("new")), f"{tmp_path}/p")
    assert sorted((r.id, r.t) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "x"), (2, "new")]
