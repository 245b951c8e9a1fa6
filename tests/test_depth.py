"""Operators on small tables that show each branch: guards, folds, clusters, repairs, trees and ranks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, official, ordering, patches, repair, snapshots, source_pages, statements, words

# --- computed indicators ------------------------------------------------------------------------------------------------


def test_a_value_that_its_components_dont_give_is_not_valid(spark):
    part = "array<struct<label:string,value:double,unit:string,operation:string,kpi_code:string,page:int,valid:boolean,warning:string>>"
    p = lambda v, op, ok=True, w=None: ("x", v, "MEUR", op, None, 1, ok, w)
    rows = [(1, 2000, "a", 50.0, "ratio", 100.0, [p(1.0, "num"), p(2.0, "den")]), (1, 2000, "b", 50.06, "ratio", 100.0, [p(1.0, "num", w="W"), p(2.0, "den", w="W")]), (1, 2000, "c", 3.0, "difference", 1.0, [p(5.0, "+"), p(2.0, "-", False)]), (1, 2000, "d", 1.0, "ratio", 100.0, [p(1.0, "num"), p(0.0, "den")])]
    got = {r.kpi_name: (r.recomputed, r.valid, r.warned, r.note) for r in official.finalised(spark.createDataFrame(rows, f"company_id int, year int, kpi_name string, value double, type string, factor double, components {part}")).collect()}
    assert got["a"] == (50.0, True, False, None) and got["c"] == (3.0, False, False, None)
    assert got["b"] == (50.0, False, True, f"W {official.MISMATCH}") and got["d"][1:] == (False, True, official.MISMATCH)


# --- patches ------------------------------------------------------------------------------------------------------------


def test_patches_by_step_guard_and_key(spark):
    table = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "y"), ("d", 4.0, "z"), ("d", 5.0, "z"), (None, 6.0, "n")], "k string, v double, u string")
    plan = [
        (1, 1, "a", "set", {"v": "1.0"}, {"v": "2"}), (2, 2, "a", "set", {"v": "2"}, {"u": None}), (3, 2, "a", "set", {"v": "1"}, {"u": "lost"}), (4, 3, "a", "delete", {"u": None}, None), (5, 4, "a", "set", None, {"v": "9"}),
        (6, 1, "b", "set", {"v": None, "u": "y"}, {"v": "7"}), (7, 1, "b", "set", {"w": "1"}, {"v": "8"}), (8, 1, "d", "set", None, {"v": "0"}), (9, 1, "e", "set", None, {"v": "0"}), (10, 1, None, "set", None, {"v": "0"}),
    ]
    done = patches.apply(table, spark.createDataFrame(plan, "patch_id long, step int, k string, action string, guards map<string,string>, sets map<string,string>"), ["k"], ["v", "u"])
    assert sorted(map(tuple, done.table.collect()), key=repr) == sorted([("b", 7.0, "y"), ("d", 4.0, "z"), ("d", 5.0, "z"), (None, 6.0, "n")], key=repr)
    journal = {r.patch_id: (r.status, r.rows, r.before) for r in done.journal.collect()}
    assert [journal[i][0] for i in range(1, 11)] == ["applied", "applied", "refused", "applied", "absent", "applied", "refused", "ambiguous", "absent", "absent"]
    assert journal[1][2] == {"v": "1.0"} and journal[2][2] == {"u": "x"} and journal[8][1] == 2 and journal[9][1] == 0
    with pytest.raises(ValueError):
        patches.applied_all(done)
    with pytest.raises(ValueError):
        patches.apply(table, spark.createDataFrame(plan, "patch_id long, step int, k string, action string, guards map<string,string>, sets map<string,string>"), ["k"], ["w"])


# --- pages --------------------------------------------------------------------------------------------------------------


def test_forms_are_found_inside_longer_runs_and_percent_is_asked_for(spark):
    pages = spark.createDataFrame([(1, 1, "R0010  x 12 345 678"), (1, 2, "see 9112345 and 45 %"), (1, 3, "rate 45 of 12 345"), (1, 4, None), (1, 5, "")], "doc int, page_no int, text string")
    targets = spark.createDataFrame([(1, "n", 12345.0, None, False, 1, 2), (1, "p", 45.0, None, True, 1, None), (1, "z", 0.0, None, False, 1, None), (1, "q", 678.0, [345678.0], False, 1, None), (1, "m", 777.0, None, False, 1, None)], "doc int, kpi_name string, value double, others array<double>, is_pct boolean, page_min int, page_max int")
    anchors = spark.createDataFrame([("n", ["R0010"], ["nothing"])], "kpi_name string, codes array<string>, labels array<string>")
    got = {r.kpi_name: (r.page, r.candidates, r.reason) for r in source_pages.find_pages(targets, pages, anchors, ["doc"]).collect()}
    assert got == {"n": (1, 1, "code near"), "p": (2, 1, "only page"), "z": (None, 0, "null or 0"), "q": (1, 1, "only page"), "m": (None, 0, "not found")}


# --- statements ---------------------------------------------------------------------------------------------------------


def folded_by_hand(lines):
    """A buffer of words, extended pairs, reset on what can't be read."""
    pairs, words_, open_ = [], [], False
    for line in lines:
        t = line.strip()
        if not t:
            continue
        if all(c in "-0123456789 .,%()" for c in t):
            values = []
            for x in [x for x in __import__("re").split(r"\s{2,}", t) if x.strip()]:
                y = x.replace(" ", "").replace(",", ".")
                y = "-" + y[1:-1] if y[:1] == "(" and y[-1:] == ")" else y
                try:
                    values.append(0.0 if y == "-" else float(y[:-1]) / 100 if y.endswith("%") else float(y))
                except ValueError:
                    values = None
                    break
            if values is None:
                words_, open_ = [], False
            elif words_:
                pairs.append((" ".join(words_).lower(), values))
                words_, open_ = [], True
            elif open_:
                pairs[-1][1].extend(values)
        else:
            words_.append(t)
            open_ = False
    return pairs


def test_folding_against_the_loop(spark):
    rnd = random.Random(3)
    choices = ["Label one", "second  half", "12", "3,5  4 %", "(7)", "1,2,3", "", "  ", "-", "1 234  -"]
    texts = {k: [rnd.choice(choices) for _ in range(rnd.randint(0, 25))] for k in range(80)}
    rows = [(k, i, x) for k, t in texts.items() for i, x in enumerate(t)]
    got = {}
    for r in statements.folded(spark.createDataFrame(rows, "k int, line_no int, line string"), ["k"]).orderBy("k", "pair_no").collect():
        got.setdefault(r.k, []).append((r.label, r["values"]))
    import re

    want = {k: [(re.sub(r"\s+", " ", a), b) for a, b in folded_by_hand(t)] for k, t in texts.items()}
    assert got == {k: v for k, v in want.items() if v}


# --- words --------------------------------------------------------------------------------------------------------------


def test_copies_of_words_against_the_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), *(lambda x, y: (x, y, x + 5, y + 2))(rnd.randint(0, 24) / 4, rnd.randint(0, 24) / 4), rnd.choice("ab")) for _ in range(400)]
    got = sorted((r.page, r.text, r.copies, round(r.x0, 6), round(r.y0, 6)) for r in words.deduplicated(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, text string"), ["page"]).collect())
    want = []
    for page in range(4):
        for text in "ab":
            left = sorted((y0, x0) for p, x0, y0, _, _, t in rows if p == page and t == text)
            while left:
                y, x = left[0]
                near = [o for o in left if abs(o[0] - y) <= 1 and abs(o[1] - x) <= 1]
                left = [o for o in left if not (abs(o[0] - y) <= 1 and abs(o[1] - x) <= 1)]
                want.append((page, text, len(near), round(sum(o[1] for o in near) / len(near), 6), round(sum(o[0] for o in near) / len(near), 6)))
    assert got == sorted(want)


def test_cells_of_a_page_without_column_codes(spark):
    rows = [(1, 10.0, 5.0, 20.0, 9.0, "R0010"), (1, 50.0, 5.5, 60.0, 9.0, "12"), (1, 63.0, 5.5, 70.0, 9.0, "345"), (1, 10.0, 30.0, 20.0, 34.0, "R0020"), (1, 10.0, 50.0, 20.0, 54.0, "R0010")]
    page = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    cells = lambda cols: sorted((r.row_code, r.col_code, r.value) for r in words.native_cells(page, ["page"], cols).collect())
    assert sorted(cells(["C0010"]), key=repr) == [("R0010", "C0010", "12345"), ("R0020", None, None)]
    assert sorted(cells(["C0010", "C0020"]), key=repr) == [("R0010", None, None), ("R0020", None, None)]


# --- chunks, repairs, trees, ranks ----------------------------------------------------------------------------------------


def test_splits_keep_words_and_units(spark):
    kinds = [(0, "text", "intro:"), (1, "list_item", "one"), (2, "list_item", "two:"), (3, "list_item", "three"), (4, "text", "plain"), (5, "list_item", "four"), (6, "list_item", "five:"), (7, "list_item", "six")]
    items = spark.createDataFrame([(1, p, k, t, 100, 1, p == 5) for p, k, t in kinds], "doc int, position int, kind string, text string, words int, page int, is_title boolean")
    assert [r.unit for r in chunks.units(items, ["doc"]).orderBy("position").collect()] == [1, 1, 1, 1, 2, 3, 4, 4]
    split = chunks.split_paragraphs(items, ["doc"], 400, 500)
    assert [(r.words, r.text) for r in split.orderBy("chunk").collect()] == [(500, "intro:\none\ntwo:\nthree\nplain"), (300, "four\nfive:\nsix")]
    assert chunks.conserved(items, split, ["doc"]).count() == 2
    titled = chunks.split_at_titles(items, ["doc"]).orderBy("chunk").collect()
    assert [(r.title, r.title_words, r.words) for r in titled] == [(None, 0, 500), ("four", 100, 200)]
    with pytest.raises(ValueError):
        chunks.conserved(items, split.where("chunk = 0"), ["doc"])


def test_row_repair_fails_cleanly(spark):
    names = [(x, x) for x in "a b c d e f g h".split()]
    tables = {1: ["a", "b", "", "c d", "e", "f"], 2: ["a", "b", "c d", "", "e", "f"], 3: ["a", "b", "", "c e", "e", "f"], 4: ["a", "", "c d", "e", "f", "g"], 5: ["b", "a", "", "c d", "e", "f"], 6: ["total", "a", "b", "c", "d", "e"]}
    rows = repair.matched(spark.createDataFrame([(t, i, x) for t, r in tables.items() for i, x in enumerate(r)], "table_id int, row_no int, label string"), names)
    found = repair.diagnosed(rows, 4)
    assert {r.table_id: r.status for r in found.collect()} == {1: "repaired", 2: "repaired", 3: "others than the gap", 4: "gap of other than two", 5: "out of scope", 6: "sound"}
    fixed = repair.repaired(rows.select("table_id", "row_no", "label"), found, names).orderBy("table_id", "row_no").collect()
    assert [r.label for r in fixed if r.table_id == 1] == list("abcdef") == [r.label for r in fixed if r.table_id == 2]


def test_nested_changes(spark):
    before = [(1, '{"a": {"b": 1, "c": [1, 2, {"d": null}]}, "e": "x", "f": {"g": 1}}'), (2, "[]"), (3, "null")]
    after = [(1, '{"a": {"b": "1", "c": [1, 3], "new": 5}, "f": [1]}'), (2, "[7]"), (3, "null")]
    of = lambda rows: spark.createDataFrame(rows, "id int, json string")
    got = lambda ignore: sorted((r.id, r.path, r.change) for r in snapshots.kept_additions(of(before), of(after), "id", ignore).collect())
    assert got([]) == [(1, "/a/b", "changed"), (1, "/a/c", "resized"), (1, "/a/c[1]", "changed"), (1, "/e", "removed"), (1, "/f", "changed"), (2, "", "resized")]
    assert got(["/a", "/f"]) == [(1, "/e", "removed"), (2, "", "resized")]


def test_global_rank_has_no_single_task(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 50).alias("v"))
    ranked = ordering.global_rank(rows, "v", "id")
    assert [r.id for r in ranked.orderBy("place").collect()] == [r.id for r in rows.orderBy("v", "id").collect()]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the sizes of the ranges, a row each


def test_greedy_groups_and_spans(spark):
    units = spark.createDataFrame([(1, i, n) for i, n in enumerate([300, 150, 60, 10, 500, 1, 499])], "doc int, pos int, n int")
    assert [(r.first, r.last, r.total) for r in ordering.greedy_groups(units, ["doc"], "pos", "n", 400, 500).orderBy("group").collect()] == [(0, 1, 450), (2, 4, 570), (5, 6, 500)]
    heads = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 2, 9), (1, 2, 9, 9), (1, 3, 2, 9), (1, 4, 1, 9)], "doc int, pos int, level int, end int")
    assert [r.subtree_end for r in ordering.subtree_span(heads, ["doc"], "pos", "level", "end").orderBy("pos").collect()] == [4, 3, 3, 4, 9]


def test_components_of_chains_stars_and_random_graphs(spark):
    from tessera.operators.components import components

    rnd = random.Random(11)
    order = list(range(200, 300))
    rnd.shuffle(order)
    edges = list(zip(order, order[1:])) + [(7, i) for i in range(8, 60)] + [(rnd.randint(400, 480), rnd.randint(400, 480)) for _ in range(50)] + [(1, 1)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
        if not changed:
            break
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()
