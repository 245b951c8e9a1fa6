"""Words with places: pages are read once, and batches, gaps and chains don't change what is found."""

import random

from tessera.operators import words
from tessera.plans import words as plans

SCHEMA = "page int, x0 double, y0 double, x1 double, y1 double, text string"


def folded(rows):
    """Copies by a plain loop."""
    seeds = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[5]), r[2], r[1] is None, r[1] or 0, r[3], r[4])):
        mine = seeds.setdefault((r[0], r[5]), [])
        near = lambda s: None not in (r[1], s[0][1]) and abs(r[1] - s[0][1]) <= 1 and abs(r[2] - s[0][2]) <= 1
        found = [s for s in mine if near(s)]
        if found:
            found[0].append(r)
        else:
            mine.append([r])
    mean = lambda s, i: None if any(r[i] is None for r in s) else round(sum(r[i] for r in s) / len(s), 6)
    return sorted(((page, text, len(s), *[mean(s, i) for i in (1, 2, 3, 4)]) for (page, text), of in seeds.items() for s in of), key=str)


def test_copies_over_batches_of_few_rows(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(9)]), r.choice([None, *[x / 4 for x in range(24)]]), r.randrange(24) / 4, 1.0 + r.randrange(9), 2.0, r.choice(["a", "b", None])) for _ in range(900)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = words.deduplicated(spark.createDataFrame(rows, SCHEMA), ["page"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(((x.page, x.text, x.copies, *[None if x[b] is None else round(x[b], 6) for b in words.BOX]) for x in got), key=str) == folded(rows)


def test_cells_read_the_words_once(spark, folder):
    """copies were folded four times, once for each part of the table; F19: each occurrence passed two windows."""
    plan = plans.table_cells(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan
    assert "Window" not in plans.duplicate_words(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_alone_are_those_of_the_cells(spark, folder):
    """completeness reads codes only."""
    found = words.native_rows(plans.page_words(spark, folder), ["page"], near=1.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(plans.table_cells(spark, folder).select("page", "row_code").distinct().collect())
