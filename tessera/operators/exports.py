"""What leaves the warehouse: comparative and whole tables as text cells, computed rows taken out and built anew, locators, costs, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import available, csv_number
from tessera.functions.text import csv_text


def comparative(values: DataFrame, companies: list[tuple[int, str]], verdicts: DataFrame, words: dict[str, str], by: list[str] = ["kpi_name"], none: str = "n.a.") -> DataFrame:  # noqa: B006
    """One row an indicator that any of the companies has a figure of: a text cell a company, companies with a warning, verdict.

    values: by, company_id, value, warning; one row an indicator and company. companies: (id, column), in order, the
    chart's parameter. verdicts: by, verdict, pointless (zeros mean that the indicator makes no sense, and are shown as
    ``none``). Figures that aren't finite are no figures. Indicators without a verdict get the empty one."""
    v = available(F.col("value"))
    rows = values.where(F.col("company_id").isin(*[i for i, _ in companies]))
    mine = lambda i, x: F.max(F.when(F.col("company_id") == i, x))
    cells = [mine(i, v).alias(f"_v{n}") for n, (i, _) in enumerate(companies)]
    warned = [mine(i, F.col("warning")).alias(f"_w{n}") for n, (i, _) in enumerate(companies)]
    wide = rows.groupBy(*by).agg(*cells, *warned).join(verdicts.select(*by, "verdict", "pointless"), by, "left")
    wide = wide.where(F.coalesce(*[F.col(f"_v{n}") for n in range(len(companies))]).isNotNull())
    empty = F.coalesce("pointless", F.lit(False))
    shown = [F.when(empty & (F.col(f"_v{n}") == 0), none).otherwise(csv_number(F.col(f"_v{n}"))).alias(name) for n, (_, name) in enumerate(companies)]
    who = F.concat_ws(", ", *[F.when(F.col(f"_w{n}").isNotNull(), F.lit(name)) for n, (_, name) in enumerate(companies)])
    notes = F.concat_ws(" | ", *[F.when(F.col(f"_w{n}").isNotNull(), F.concat(F.lit(f"{name}: "), F.col(f"_w{n}"))) for n, (_, name) in enumerate(companies)])
    said = F.coalesce(F.create_map(*[F.lit(x) for p in words.items() for x in p])[F.col("verdict")], F.lit(""))
    return wide.select(*by, *shown, csv_text(who).alias("warned"), csv_text(notes).alias("notes"), said.alias("verdict"))


def whole_rows(companies: DataFrame, names: list[tuple[str, str]], values: DataFrame) -> DataFrame:
    """Each company with each indicator (names: the catalogue's names and units) as text cells; what is absent is empty.

    values: company_id, kpi_name, value, raw_value, raw_unit, source_page, warning. Raw figure, page and note are shown
    only beside a figure."""
    on = ["company_id", "kpi_name"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kpi_name"), F.lit(u).alias("unit")) for n, u in names])).alias("k")
    j = companies.select("company_id", "name", each).select("company_id", "name", "k.*").join(values, on, "left")
    v = available(F.col("value"))
    beside = lambda x: F.when(v.isNotNull() & x.isNotNull(), x).otherwise("")
    raw = F.col("raw_value").isNotNull()
    return j.select(
        csv_text(F.col("name")).alias("company"), F.col("kpi_name"), csv_number(v).alias("value"), csv_text(F.col("unit")).alias("unit"), beside(F.when(raw, csv_number(F.col("raw_value")))).alias("raw_value"),
        beside(F.when(raw, csv_text(F.col("raw_unit")))).alias("raw_unit"), beside(F.col("source_page").cast("string")).alias("page"), F.when(F.col("warning").isNotNull(), "not comparable").otherwise("").alias("warned"), F.coalesce(csv_text(F.col("warning")), F.lit("")).alias("note"),
    )


def rebuilt(tables: dict[str, DataFrame], made: dict[str, DataFrame], names: list[str], year: int | None = None) -> dict[str, DataFrame]:
    """Each table without the rows of the computed names (of one year, or all), then with those of ``made``: the same however often it runs.

    Tables have kpi_name and year. Rows of other names, or without one, stay; a table that ``made`` lacks only loses rows."""
    old = F.coalesce(F.col("kpi_name").isin(*names), F.lit(False))
    if year is not None:
        old = old & F.coalesce(F.col("year") == year, F.lit(False))
    return {n: t.where(~old).unionByName(made[n]) if n in made else t.where(~old) for n, t in tables.items()}


def template_locators(pages: DataFrame, code: str, heading: str, number: str, first: int = 5, window: int = 20, most: int = 80) -> DataFrame:
    """(doc, method, pages, missing, reliable): pages with templates, found in three ways; those of a full scan are the reference.

    pages: doc, page_no (from 1), text. contents: numbers at the end of lines on the first pages that look like an entry
    (``heading``). tail: the hits of the last ``window`` pages, the window doubled up to ``most`` until it starts with a
    page that isn't a hit, and none larger than the document, so that short ones give none; scan: the hits of all. A way is reliable if it finds pages and misses none. Every window is
    one condition on the page's distance from the end, so a document is read once."""
    size = pages.groupBy("doc").agg(F.max("page_no").alias("_n"))
    hits = pages.where(F.col("text").rlike(code)).select("doc", "page_no").distinct()
    lines = pages.where(F.col("page_no") <= first).select("doc", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(heading))
    told = lines.select("doc", F.regexp_extract(F.trim("line"), number, 1).try_cast("int").alias("page_no")).where("page_no IS NOT NULL")
    sizes = []
    while window <= most:
        sizes.append(window)
        window *= 2
    start = lambda w: F.greatest(F.lit(1), F.col("_n") - w + 1)
    near = hits.join(size, "doc")
    firsts = near.groupBy("doc", "_n").agg(*[F.min(F.when(F.col("page_no") >= start(w), F.col("page_no"))).alias(f"_f{w}") for w in sizes])
    enough = lambda w: F.col(f"_f{w}").isNotNull() & (F.col(f"_f{w}") > start(w))
    tried = lambda w: F.lit(w) <= F.col("_n")
    chosen: Column = F.coalesce(*[F.when(tried(w) & enough(w), F.lit(w)) for w in sizes], *[F.when(tried(w), F.lit(w)) for w in reversed(sizes)])
    tail = near.join(firsts.select("doc", chosen.alias("_w")).where("_w IS NOT NULL"), "doc").where(F.col("page_no") >= F.greatest(F.lit(1), F.col("_n") - F.col("_w") + 1)).select("doc", "page_no")
    label = lambda df, m: df.select("doc", F.lit(m).alias("method"), "page_no").distinct()
    found = label(told, "contents").union(label(tail, "tail")).union(label(hits, "scan"))
    known = hits.withColumn("_ref", F.lit(1))
    per = found.join(known, ["doc", "page_no"], "left").groupBy("doc", "method").agg(F.count("*").alias("pages"), F.sum(F.coalesce("_ref", F.lit(0))).alias("_hit"))
    every = size.select("doc", F.explode(F.array(*[F.lit(m) for m in ("contents", "tail", "scan")])).alias("method")).join(hits.groupBy("doc").agg(F.count("*").alias("_all")), "doc", "left")
    j = every.join(per, ["doc", "method"], "left").select("doc", "method", F.coalesce("pages", F.lit(0)).alias("pages"), (F.coalesce("_all", F.lit(0)) - F.coalesce("_hit", F.lit(0))).alias("missing"))
    return j.withColumn("reliable", (F.col("missing") == 0) & (F.col("pages") > 0))


def answer_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """What an answer cost, at prices a million tokens."""
    return tokens_in * price_in / 1_000_000 + tokens_out * price_out / 1_000_000


#: Folder and file prefix of each kind of reference.
FOLDERS = {"tables": ("tables", "table"), "pictures": ("images", "picture")}


def visual_path(ref: Column, year: Column) -> Column:
    """Where the file of a reference such as #/tables/16 lies; null for any other form."""
    kind, number = F.regexp_extract(ref, r"^#/(tables|pictures)/(\d+)$", 1), F.regexp_extract(ref, r"^#/(tables|pictures)/(\d+)$", 2)
    folder, prefix = [F.create_map(*[F.lit(x) for k, v in FOLDERS.items() for x in (k, v[i])])[kind] for i in (0, 1)]
    return F.when(kind != "", F.concat(year.cast("string"), F.lit("/"), folder, F.lit("/"), prefix, F.lit("_"), F.regexp_replace(number, r"^0+(?=\d)", ""), F.lit(".png")))


def page_path(page: Column, year: Column) -> Column:
    """Where the picture of a whole page lies."""
    return F.concat(year.cast("string"), F.lit("/pages/page_"), page.cast("string"), F.lit(".png"))
