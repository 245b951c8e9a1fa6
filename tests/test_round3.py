"""What findings of round 3 were about."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import controls, indicators, layout, places, snapshots, statements
from tessera.plans import official, reports


def test_lines_with_narrow_spaces_stand_in_order_of_what_they_say(spark):
    """two first lines of an order, 6 776 043 before 639 706, as in the SQL."""
    lines = spark.createDataFrame([(1, 1, 1, 5.0, 0.0, x) for x in (639706, 6776043)], "company_id long, page_no int, l_linenumber int, l_quantity double, l_discount double, cents long")
    text = reports.report_pages(lines).where("page_no = 1").select(F.translate("text", "\u202f", " ")).first()[0]
    assert text.index("6 776 043") < text.index("639 706")


def test_range_join_deals_a_full_bucket_into_cells(spark, monkeypatch):
    """one bucket holds all; sides aren't broadcast, and its rows meet in cells."""
    monkeypatch.setattr(places, "CELL", 64, raising=False)
    points = spark.range(1000).select(F.lit(1).alias("k"), "id", (F.col("id") % 9).alias("x"))
    ranges = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("r"), (F.col("id") % 5).alias("lo"), (F.col("id") % 5 + 3).alias("hi"))
    got = places.range_join(points, ranges, ["k"], "x", "lo", "hi", 10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "strategy=merge" in plan
    want = [(p, r) for p in range(1000) for r in range(300) if r % 5 <= p % 9 <= r % 5 + 3]
    assert sorted(tuple(x) for x in got.select("id", "r").collect()) == want


def test_figures_of_an_array_are_those_of_its_texts(spark):
    """parse_numbers strips a text once; its figures are parse_number's."""
    texts = ["1 234,5", "12", "-", "–", "−", "−5", "–5", "(7)", "()", "(-)", "5 %", "12,5%", "1,2,3", "1.", ".5", "", "x", "- 3", "1e5", "(5)%", "-(5)", "1−2", None]
    row = spark.createDataFrame([(texts,)], "t array<string>").select(numbers.parse_numbers(F.col("t")).alias("a"), F.transform("t", numbers.parse_number).alias("b")).first()
    assert row["a"] == row["b"]
    assert row["a"][:8] == [1234.5, 12.0, 0.0, 0.0, 0.0, -5.0, -5.0, -7.0] and row["a"][8] is None and row["a"][10] == 0.05


def test_folded_reads_lines_without_lists_in_maps(spark):
    """pairs come from windows over one order of a text's lines; a line that can't be read ends its pair only."""
    texts = ["5", "Gross", "direct", "1  2", "", "3", "Life", "1,2,3", "4", "Net", "(6)", "7,8,9", "8", "Últimos", "9"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "k int, line_no int, line string").repartition(3)
    got = statements.folded(lines, ["k"])
    assert "collect_list" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    rows = [(r.pair_no, r.label, r["values"]) for r in got.orderBy("pair_no").collect()]
    assert rows == [(1, "gross direct", [1.0, 2.0, 3.0]), (3, "net", [-6.0]), (4, "ultimos", [9.0])]


def test_values_near_an_anchor_are_not_held_once_a_pair(spark):
    """all pairs were told apart in memory; now values are, and each meets its bucket's anchors in one row."""
    values = spark.createDataFrame([(1, 7, 10), (1, 7, 10), (1, 8, 50), (1, None, 90), (2, None, 5), (1, 9, None)], "page int, value int, pos int")
    anchors = spark.createDataFrame([(1, "a", 12), (1, "a", 14), (1, None, 49), (1, "b", 500), (2, "c", 5), (2, "d", None)], "page int, anchor string, pos int")
    got = layout.within_window(values, anchors, ["page"], 40)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 2), (1, None, 2), (2, "c", 0)]
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("array_distinct", "")


def test_trees_are_parsed_once_and_walked_together(spark):
    """F16: each level parsed all trees again, and nodes met by path; now both trees of a key meet in one row."""
    before = [(1, '{"a": null, "b": [null, 1, {}], "c": {"x": {"y": [1, "2"]}}, "d": 1.50, "e": {}, "s": "1"}'), (2, "{}"), (3, None), (4, "1"), (5, '{"q": 1}')]
    after = [(1, '{"a": 0, "b": [null, 1.0, [], 4], "c": {"x": {"y": [1, 2]}}, "d": 1.5, "s": 1, "z": {"deep": [[[[1]]]]}}'), (2, "[]"), (3, "1"), (4, None), (6, "{}")]
    of = lambda rows: spark.createDataFrame(rows, "id int, json string")
    got = snapshots.kept_additions(of(before), of(after), "id", depth=5)
    want = [(1, "/a", "changed"), (1, "/b", "resized"), (1, "/b[2]", "changed"), (1, "/c/x/y[1]", "changed"), (1, "/e", "removed"), (1, "/s", "changed"), (2, "", "changed"), (3, "", "changed"), (4, "", "changed")]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r for r in rows if r[1] not in ("/b[1]", "/d")] == want  # whether 1 and 1.0 are one text is the variant's
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 4 and plan.count("Join") == 1
    with pytest.raises(Exception, match="deeper than 2"):
        snapshots.kept_additions(of(before), of(after), "id", depth=2).collect()


def test_flags_are_looked_up_by_company_and_year(spark):
    """the long table was sorted to meet a flag a row; now one narrow row a company and year is looked up."""
    kpis = spark.createDataFrame([(1, 2020, "own_funds", False), (1, 2020, "mcr", True), (1, 2020, "tier1", True), (2, 2020, "own_funds", None), (1, None, "mcr", True)], "company_id int, year int, kpi_name string, validated boolean")
    found = spark.createDataFrame([(1, 2020, "sign_own_funds", True), (1, 2020, "identity_own_funds", True), (1, 2020, "mcr_below_scr", None), (2, 2020, "own_funds", True), (2, 2020, "x_own_funds", False), (3, 2020, "mcr", False)], "company_id int, year int, check_name string, passed boolean")
    got = indicators.validated_flags(kpis, found, ["own_funds", "mcr"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2020, "mcr", True), (1, 2020, "own_funds", True), (1, 2020, "tier1", True), (1, None, "mcr", True), (2, 2020, "own_funds", False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and plan.count("kpi_name") < plan.count("year") * 2
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_ratios_of_computed_indicators_are_worked_out_once(spark, folder):
    """a ratio was worked out again wherever it stood; now it is a column."""
    plan = official.indicators(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" div ") <= 30  # 42 before, 24 after


def test_lines_meet_amounts_in_one_bucket_each(spark):
    """a line went into three buckets for each scale; now into one, also where buckets change their width, and none is missed."""
    at, scales = ["k"], [1.0, 1000.0]
    edges = [0.0, 0.5, 16.0, 32.0, 2.0**20, 2.0**21, 2.0**22, 2.0**30, 2.0**40]
    shown = sorted({x for e in edges for g in (0.0, 0.5, 1.0, 7.0, e * 1e-6, e * 1e-6 + 0.5) for x in (round(e + g, 1), round(e - g, 1))})
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(edges) if v] + [(2, 0, 5.0)], "k int, idx int, value double")
    amounts = spark.createDataFrame([(1, x, 1) for x in shown] + [(2, 5000.4, 0)], "k int, amount double, decimals int")
    got = controls.printed_lines(lines, amounts, at, scales)
    want = {(1, i): min(x for x in shown if abs(x - v) <= 0.05 + 1e-6 * max(v, 1)) for i, v in enumerate(edges) if v}
    assert {(r.k, r.idx): r.printed for r in got.collect()} == want | {(2, 0): 5000.4}
    net = controls.gross_share_net(got, amounts, at)
    assert net.where("k = 2").first()["gross"] == 5000.0
    assert "sequence(" not in net._jdf.queryExecution().optimizedPlan().toString()
