"""Words with places on a page: copies put together, and the cells of a table read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

BOX = ["x0", "y0", "x1", "y1"]


def deduplicated(words: DataFrame, page: list[str], near: float = 1.0, listed: bool = False) -> DataFrame:
    """(page, x0, y0, x1, y1, text): copies of a word become one at the mean of their boxes, with their number.

    Occurrences of a text go from top to bottom, then left to right; each joins the first seed within ``near`` either way,
    or becomes a seed itself, so a chain of near words may give several. Only what is connected can meet: occurrences are
    parted where y jumps by more than ``near``, then where x does. A task gets its pages one after the other, and all
    parts of a batch of pages take a seed at once: the first occurrence left, and with it all that are near. ``listed``
    gives a row a page, with its words as ``words``."""
    rows = words.select(*page, *[F.col(b).cast("double").alias(b) for b in BOX], "text")
    schema = StructType([*rows.schema.fields, StructField("copies", LongType())])
    if listed:
        schema = StructType([*schema.fields[: len(page)], StructField("words", ArrayType(StructType(schema.fields[len(page) :])))])
    box, limit = list(BOX), near

    def changes(np, columns):
        """Where a row differs from the one before it."""
        new = np.zeros(len(columns[0]), bool)
        for x in columns:
            codes = x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def seeds(np, pa, t):
        keys = [t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in [*page, "text"]]
        v = [t[b].to_numpy() for b in box]
        by = np.lexsort([v[3], v[2], v[0], v[1], *keys[::-1]])
        new = np.ones(len(by), bool)
        new[1:] = np.diff(v[1][by]) > limit
        for k in keys:
            new[1:] |= k[by][1:] != k[by][:-1]
        part = np.cumsum(new)
        across = np.lexsort([v[0][by], part])
        new[1:] = (np.diff(v[0][by][across]) > limit) | (np.diff(part[across]) != 0)
        part[across] = np.cumsum(new)
        order = np.argsort(part, kind="stable")
        by, part = by[order], part[order]
        x, y, seed, firsts, n = v[0][by], v[1][by], np.zeros(len(by), "int64"), [], 0
        left = np.arange(len(by))
        while len(left):
            new = np.ones(len(left), bool)
            new[1:] = np.diff(part[left]) != 0
            at, first = np.cumsum(new) - 1, left[new]
            close = new | (np.abs(x[left] - x[first][at]) <= limit) & (np.abs(y[left] - y[first][at]) <= limit)
            seed[left[close]] = n + at[close]
            firsts.append(first)
            n, left = n + len(first), left[~close]
        at, copies = by[np.concatenate(firsts)], np.bincount(seed)
        rank = np.argsort(at)  # as the rows came, so that a page's words stay together
        out = {k: t[k].combine_chunks().take(pa.array(at[rank])) for k in [*page, "text"]}
        for i, b in enumerate(box):
            holes = (np.bincount(seed, weights=t[b].is_null().to_numpy()[by]) > 0)[rank] if t[b].null_count else None
            out[b] = pa.array((np.bincount(seed, weights=v[i][by]) / copies)[rank], mask=holes)
        out["copies"] = pa.array(copies[rank], "int64")
        own = [*box, "text", "copies"]
        if not listed:
            return pa.RecordBatch.from_pydict({k: out[k] for k in [*page, *own]})
        new = np.flatnonzero(changes(np, [out[k] for k in page]) | (np.arange(n) == 0))
        lists = pa.ListArray.from_arrays(pa.array([*new, n], "int32"), pa.StructArray.from_arrays([out[k] for k in own], own))
        return pa.RecordBatch.from_pydict({**{k: out[k].take(pa.array(new)) for k in page}, "words": lists})

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            new = np.flatnonzero(changes(np, [batch.column(k) for k in page])) if batch.num_rows else []
            if len(new):
                yield seeds(np, pa, pa.Table.from_batches([*held, batch.slice(0, new[-1])]))
                held = []
            held.append(batch.slice(new[-1]) if len(new) else batch)
        if sum(x.num_rows for x in held):
            yield seeds(np, pa, pa.Table.from_batches(held))

    return rows.repartition(*page).sortWithinPartitions(*page).mapInArrow(fold, schema)


def native_cells(words: DataFrame, page: list[str], columns: list[str], row_code: str = r"^R\d{4}$", col_code: str = r"^C\d{4}$", figure: str = r"^[-+(]?\d[\d.,]*%?\)?$|^-$", line: float = 1.5, above: float = 10.0, gap: float = 5.0, near: float | None = None) -> DataFrame:
    """(page, x0, y0, x1, y1, text) to (page, row_code, col_code, value): the cells of a table whose rows and columns are told by codes.

    The header ends where the highest column code does. Rows are the first occurrence of each row code below it; a row's
    figures are those right of its code at its height, to ``line``; if there is none, also those up to ``above`` higher.
    Neighbours no more than ``gap`` apart are one figure, which goes to the column whose code's centre is nearest (equal
    ones: the lower code); of two in a column the right one stays. A page without column codes continues a table: its
    figures are read only if the table has one column. A row without figures has one row with nulls. With ``near``, copies
    of codes and figures are put together first, as in ``deduplicated``. A page is read whole, from one row."""
    read = F.col("text").rlike(row_code) | F.col("text").rlike(col_code) | F.col("text").rlike(figure)
    one = F.struct(*BOX, "text")
    listed = words.where(read).groupBy(*page).agg(F.collect_list(one).alias("words")) if near is None else deduplicated(words.where(read), page, near, listed=True)
    mine = lambda pattern, *order: F.sort_array(F.transform(F.filter("words", lambda x: x["text"].rlike(pattern)), lambda x: F.struct(*[x[k].alias(k) for k in order])))
    pages = listed.select(*page, mine(col_code, "text", "y0", "x0", "x1", "y1").alias("_h"), mine(row_code, "text", "y0", "x0", "x1").alias("_r"), mine(figure, "x0", "x1", "text", "y0").alias("_f"))
    last = F.filter("_h", lambda x, i: (i == F.size("_h") - 1) | (F.get("_h", i + 1)["text"] != x["text"]))
    cols = F.transform(last, lambda x: F.struct(((x["x0"] + x["x1"]) / 2).alias("centre"), x["text"].alias("code")))
    top = F.coalesce(F.array_min(F.transform("_h", lambda x: x["y1"])), F.lit(0.0))
    pages = pages.select(*page, cols.alias("_cols"), "_f", F.filter("_r", lambda x: x["y0"] > top).alias("_r"))
    rows = pages.select(*page, "_cols", "_f", F.explode(F.filter("_r", lambda x, i: (i == 0) | (F.get("_r", i - 1)["text"] != x["text"]))).alias("r"))
    reached = F.filter("_f", lambda f: (f["x0"] > F.col("r.x1")) & (f["y0"] - F.col("r.y0") <= line) & (F.col("r.y0") - f["y0"] <= above))
    rows = rows.select(*page, F.col("r.text").alias("row_code"), "_cols", reached.alias("_f"), F.col("r.y0").alias("_y"))
    level = lambda f: F.abs(f["y0"] - F.col("_y")) <= line
    rows = rows.withColumn("_f", F.when(F.exists("_f", level), F.filter("_f", level)).otherwise(F.col("_f")))
    # neighbours are put together from left to right; a run holds its figure, its ends and where the last piece ends
    run = "array<struct<value:string,low:double,high:double,end:double>>"
    alone = lambda f: F.struct(f["text"].alias("value"), f["x0"].alias("low"), f["x1"].alias("high"), f["x1"].alias("end"))

    def grown(runs: Column, f: Column) -> Column:
        old = F.try_element_at(runs, F.lit(-1))
        new = F.struct(F.concat(old["value"], f["text"]).alias("value"), old["low"].alias("low"), F.greatest(old["high"], f["x1"]).alias("high"), f["x1"].alias("end"))
        joins = (F.size(runs) > 0) & (f["x0"] - F.try_element_at(runs, F.lit(-1))["end"] <= gap)
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(new))).otherwise(F.concat(runs, F.array(alone(f))))

    single = F.lit(columns[0]) if len(columns) == 1 else F.lit(None).cast("string")
    nearest = lambda x: F.array_min(F.transform("_cols", lambda h: F.struct(F.abs(h["centre"] - (x["low"] + x["high"]) / 2), h["code"].alias("code"))))["code"]
    placed = F.transform("_runs", lambda x: F.struct(F.when(F.size("_cols") == 0, single).otherwise(nearest(x)).alias("col_code"), x["value"].alias("value")))
    rows = rows.withColumn("_runs", F.aggregate("_f", F.expr(f"cast(array() as {run})"), grown)).withColumn("_p", placed)
    right = F.filter("_p", lambda x, i: x["col_code"].isNotNull() & ~F.exists(F.slice("_p", i + 2, F.size("_p")), lambda z: z["col_code"] == x["col_code"]))
    return rows.select(*page, "row_code", F.explode_outer(right).alias("c")).select(*page, "row_code", "c.col_code", "c.value")


def native_rows(words: DataFrame, page: list[str], row_code: str = r"^R\d{4}$", col_code: str = r"^C\d{4}$", near: float | None = None) -> DataFrame:
    """(page, row_code): the rows of ``native_cells`` alone, for which no figure is read."""
    codes = words.where(F.col("text").rlike(row_code) | F.col("text").rlike(col_code))
    codes = codes if near is None else deduplicated(codes, page, near)
    own, head = F.col("text").rlike(row_code), F.col("text").rlike(col_code)
    low = codes.where(own | head).groupBy(*page, "text").agg(F.max(F.when(own, F.col("y0"))).alias("_y"), F.min(F.when(head, F.col("y1"))).alias("_t"))
    top = F.coalesce(F.min("_t").over(Window.partitionBy(*page)), F.lit(0.0))
    return low.withColumn("_top", top).where(F.col("_y") > F.col("_top")).select(*page, F.col("text").alias("row_code"))


def completeness(cells: DataFrame, page: list[str], expected: list[str]) -> DataFrame:
    """Row codes of each page against those expected: numbers of both, missing and unexpected ones."""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    found = cells.groupBy(*page).agg(F.sort_array(F.collect_set("row_code")).alias("f"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return found.select(*page, F.lit(len(expected)).alias("n_expected"), F.size("f").alias("n_found"), text(F.array_except(want, F.col("f"))).alias("missing"), text(F.array_except(F.col("f"), want)).alias("unexpected"))


def empty_suspects(counts: DataFrame, sheet: list[str], page: str) -> DataFrame:
    """(sheet, page, n): pages of a sheet without row codes that gave nothing while another page of it gave something.

    How many pages did, and the first of them, go along; sheets of one page have nothing to be compared with."""
    w = Window.partitionBy(*sheet)
    with_some = counts.withColumns({"filled_pages": F.count_if(F.col("n") > 0).over(w), "first_filled": F.min(F.when(F.col("n") > 0, F.col(page))).over(w)})
    return with_some.where("n = 0 AND filled_pages > 0").select(*sheet, page, "filled_pages", "first_filled")
