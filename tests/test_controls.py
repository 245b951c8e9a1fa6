"""Controls, measures, exports and texts for readers against small cases worked by hand or by plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sources
from tessera.operators import controls, exports, measures

LINES = "k long, section string, idx int, value double"
AMOUNTS = "k long, section string, amount double, decimals int"
SCALES = [1000.0, 1.0]


def by_loops(lines, amounts):
    """section_controls by plain loops over all pairs."""
    out = {}
    for k, s in sorted({(a, b) for a, b, _, v in lines if v is not None}):
        own = sorted((i, v) for a, b, i, v in lines if (a, b) == (k, s) and v is not None)
        shown = sorted({(x, d) for a, b, x, d in amounts if (a, b) == (k, s) and x is not None})
        if not shown:
            out |= {(k, f"line_{s}_{i}"): (False, False) for i, _ in own}
            continue
        prints = lambda t: [x for x, d in shown if abs(x - t) <= 0.5 * 10**-d + 1e-6 * max(t, 1)]  # noqa: E731, B023
        scale = max(SCALES, key=lambda f: sum(bool(prints(abs(v) * f)) for _, v in own if v))  # noqa: B023
        hit = {i: prints(abs(v) * scale)[:1] for i, v in own if v}
        free = [(x, d) for x, d in shown if x > 0 and [x] not in hit.values()]
        gross, tol = sum(v for _, v in own) * scale, 0.5 * (len(own) + 2)
        adds = any(abs(abs(gross - p) - n) <= tol * 10 ** -min(e, f) for (p, e), (n, f) in itertools.product(free, free))
        out[k, f"identity_{s}"] = (adds, True)
        out |= {(k, f"line_{s}_{i}"): (adds and (not v or bool(hit[i])), True) for i, v in own}
    return out


def test_section_controls_by_loops(spark):
    r = random.Random(5)
    lines, amounts = [], []
    for k in range(60):
        s, f, d = r.choice("ab"), r.choice(SCALES), r.choice([0, 1])
        own = [r.choice([0.0, round(r.uniform(-50, 900), 3)]) for _ in range(r.randint(1, 5))]
        lines += [(k, s, i, v) for i, v in enumerate(own)]
        if k % 7:
            amounts += [(k, s, round(abs(v) * f, d), d) for v in own if r.random() < 0.8]
            part = round(sum(own) * f * r.random(), d)
            amounts += [(k, s, abs(part), d), (k, s, round(abs(sum(own) * f - part) + r.choice([0, 0, 40 * f]), d), d)]
    lines += [(1, "b", 99, None), (77, None, 1, 5.0)]
    amounts += amounts[:9] + [(2, "a", None, 0)]
    got = controls.section_controls(spark.createDataFrame(lines, LINES), spark.createDataFrame(amounts, AMOUNTS), ["k"], SCALES).where("k < 77").collect()
    assert {(x["k"], x["check_name"]): (x["passed"], x["controllable"]) for x in got} == by_loops([x for x in lines if x[1]], amounts)
    assert len(got) == len({(x["k"], x["check_name"]) for x in got})


def test_section_controls_of_nothing(spark):
    none, some = spark.createDataFrame([], LINES), spark.createDataFrame([(1, "a", 1, 2.0)], LINES)
    empty = spark.createDataFrame([], AMOUNTS)
    assert controls.section_controls(none, empty, ["k"], SCALES).count() == 0
    assert [x["reason"] for x in controls.section_controls(some, empty, ["k"], SCALES).collect()] == ["no amount in the section"]


def test_ratio_control_skips_what_cannot_be_divided(spark):
    lines = spark.createDataFrame([(1, "up", 1, 3.0), (1, "down", 2, 4.0), (2, "up", 1, 3.0), (3, "up", 1, 1.0), (3, "down", 1, 0.0)], LINES)
    stored = spark.createDataFrame([(1, 75.04), (2, 1.0), (3, 1.0), (4, 1.0), (1, None)], "k long, ratio double")
    assert [(x["k"], x["computed"], x["passed"]) for x in controls.ratio_control(lines, stored, ["k"], "up", "down", 0.05).collect()] == [(1, 75.0, True)]


def test_ranges_and_explanations(spark):
    x = spark.createDataFrame([(1, "life", 1.0), (2, "life", 5.0), (3, "other", 5.0), (4, None, 1.0), (5, "life", None)], "k long, kind string, v double")
    assert [(r["k"], r["passed"]) for r in controls.in_range_by(x, {"life": (1.0, 2.0)}, "kind", "v").orderBy("k").collect()] == [(1, True), (2, False)]
    assert controls.in_range_by(x, {}, "kind", "v").count() == 0
    found = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "b", False)], "k long, check_name string, passed boolean")
    known = spark.createDataFrame([(1, "a", "never"), (1, "b", "known")], "k long, check_name string, explanation string")
    got = {(r["k"], r["check_name"]): (r["state"], r["explanation"]) for r in controls.annotated(found, known, ["k", "check_name"]).collect()}
    assert got == {(1, "a"): ("passed", None), (1, "b"): ("explained", "known"), (2, "b"): ("failed", None)}


TABLES = "company_id long, year int, unit string, fp_with double, scr_with double, d_fp_va double, d_scr_va double, d_fp_tr double, d_scr_tr double"


def test_measure_table_is_whole_or_an_error(spark):
    tables = spark.createDataFrame([(1, 2025, "thousands", 2000.0, 1000.0, -100.0, None, None, 0.0), (2, 2025, "units", 5e6, 1e6, None, None, -2e5, None), (4, 2025, "acres", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], TABLES)
    published = spark.createDataFrame([(2, 2025, 150.0), (3, 2025, 180.0)], "company_id long, year int, published_ratio double")
    unused = spark.createDataFrame([(5, 2025)], "company_id long, year int")
    made = {r["company_id"]: r for r in measures.measure_table(tables, published, unused).collect()}
    assert sorted(made) == [1, 2, 3, 4, 5]
    assert (made[1]["fp_with"], made[1]["d_fp_va"], made[1]["d_scr_va"], made[1]["transitional"]) == (2.0, -0.1, 0.0, False)
    assert (made[2]["published_ratio"], made[2]["transitional"], made[2]["fp_with"]) == (None, True, 5.0)  # the table comes first
    assert (made[3]["published_ratio"], made[3]["d_fp_va"], made[3]["uses_va"]) == (180.0, None, True)
    assert made[4]["fp_with"] is None and made[5]["uses_va"] is False
    stored = spark.createDataFrame([(1, 2025, 2.01, 1.0), (2, 2025, 5.0, 1.0)], "company_id long, year int, own_funds double, scr_total double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "company_id long")
    assert measures.whole_measure_table(ids(1, 2), stored, tables, published, unused).count() == 5
    with pytest.raises(ValueError, match="no row"):
        measures.whole_measure_table(ids(1, 9), stored, tables, published, unused)
    with pytest.raises(ValueError, match="unlike"):
        measures.whole_measure_table(ids(1), stored.withColumn("own_funds", F.col("own_funds") + 1), tables, published, unused)


def test_comparative_drops_rows_without_figures(spark):
    rows = [("a", 1, 0.0, None), ("a", 2, 1234.5, "x;y"), ("b", 1, None, None), ("b", 3, 5.0, None), ("c", 1, float("inf"), None), ("d", 2, 0.0, None)]
    values = spark.createDataFrame(rows, "kpi_name string, company_id long, value double, warning string")
    verdicts = spark.createDataFrame([("a", "R", True)], "kpi_name string, verdict string, pointless boolean")
    got = {r["kpi_name"]: tuple(r)[1:] for r in exports.comparative(values, [(1, "one"), (2, "two")], verdicts, {"R": "with care"}).collect()}
    assert got == {"a": ("n.a.", "1234,5", "two", '"two: x;y"', "with care"), "d": ("", "0", "", "", "")}


def test_rebuilt_twice_is_rebuilt_once(spark):
    t = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 1)], "kpi_name string, year int")
    made = spark.createDataFrame([("x", 1)], "kpi_name string, year int")
    once = exports.rebuilt({"a": t, "b": t}, {"a": made}, ["x"], year=1)
    twice = exports.rebuilt(once, {"a": made}, ["x"], year=1)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(once["a"]) == rows(twice["a"]) and twice["a"].count() == 4 and once["b"].count() == 3


def scan_from_end(hits, n, window=20, most=80):
    found = []
    while window <= min(most, n):
        found = [p for p in hits if p > max(0, n - window)]
        if found and found[0] > max(0, n - window) + 1:
            break
        window *= 2
    return found


def test_locators_by_loops(spark):
    r = random.Random(3)
    pages, want = [], {}
    for doc in range(40):
        n = r.choice([3, 19, 20, 25, 40, 79, 80, 130])
        first = r.randint(1, n + 1)
        hits = [p for p in range(1, n + 1) if p >= first or r.random() < 0.03]
        pages += [(doc, p, "S.23.01.01 table" if p in hits else None if p % 9 == 0 else "words") for p in range(1, n + 1)]
        tail = scan_from_end(hits, n)
        want[doc, "tail"] = (len(tail), len(hits) - len(tail))
        want[doc, "scan"] = (len(hits), 0)
    got = exports.template_locators(spark.createDataFrame(pages, "doc long, page_no int, text string"), r"S\.\d{2}", "annex", r"(\d+)$").collect()
    assert {(x["doc"], x["method"]): (x["pages"], x["missing"]) for x in got if x["method"] != "contents"} == want
    assert all(x["reliable"] == (x["missing"] == 0 and x["pages"] > 0) for x in got)


def test_texts_for_readers(spark):
    one = lambda text, *f: spark.createDataFrame([(text,)], "t string").select(*f).first()
    assert one("ﬁ x １", sources.compatible(F.col("t")))[0] == "fi x 1"
    assert one(None, sources.compatible(F.col("t")))[0] is None
    notes = [(r"(\d+) lines", "$1 lines read"), ("image", "from a picture"), ("bad", "see own_funds")]
    simple = lambda t: tuple(one(t, sources.simple_source(F.col("t"), [("Own", "By hand.")], {"23.01": "own funds"}, {"E.1": "funds"}, notes))[0])
    assert simple("S.23.01.22 image, 12 lines\nmore") == ("Official table S.23.01 (own funds of the group) — 12 lines read; from a picture", None)
    assert simple("E.1 — x") == ("Report, chapter E.1 (funds)", None)
    assert simple("Own work") == ("By hand.", None) and simple(None) == (None, None)
    assert simple("S.99.01") == (None, "unknown place") and simple("E.1 — bad") == (None, "still technical")
    label = lambda t: one(t, sources.prefixed_label(F.col("t"), "Premiums"))[0]
    assert [label("Life [R0010]"), label("PREMIUMS life"), label(None)] == ["Premiums: Life", "PREMIUMS life", "Premiums: "]
    path = lambda t: one(t, exports.visual_path(F.col("t"), F.lit(2025)))[0]
    assert [path("#/tables/016"), path("#/pictures/0"), path("#/texts/1"), path(None)] == ["2025/tables/table_16.png", "2025/images/picture_0.png", None, None]
