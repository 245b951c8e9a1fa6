"""Tables that were printed as plain lines: labels folded with the figures after them, sections, and figures by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import parse_number, parse_numbers
from tessera.functions.text import label_key

#: A line is of figures if it has nothing but digits and what stands beside them.
FIGURES = r"^[-−–\d\s.,%()]+$"
#: So many spaces part columns.
GAP = r"\s{2,}"


def cells(line: Column) -> Column:
    """The columns of a line of figures."""
    return F.filter(F.split(F.trim(line), GAP), lambda x: F.trim(x) != "")


def folded(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_no, line) to (key, pair_no, label, values): lines of words with the figures that follow them.

    Words in a row make one label. Lines of figures after it add their columns to its values, until words come or a line
    that can't be read, which ends the pair; what follows that, or comes before any label, belongs to none. A label
    whose first line of figures can't be read makes no pair. Blank lines don't count. A label is in lower case without
    accents, spaces as one. Transitions between words and figures are counted, so no state is carried from line to line; a pair's
    lines are listed in their order by a window, so no list is sorted or kept in a map."""
    rows = lines.where(F.trim("line") != "").withColumn("_figures", F.trim("line").rlike(FIGURES))
    rows = rows.withColumn("_read", F.when(F.col("_figures"), parse_numbers(cells(F.col("line")))))
    w = Window.partitionBy(*key).orderBy("line_no")
    bad = F.col("_figures") & F.exists("_read", lambda x: x.isNull())
    starts = ~F.col("_figures") & F.coalesce(F.lag("_figures").over(w), F.lit(True))
    rows = rows.withColumns({"_bad": bad, "_starts": starts})
    so_far = lambda flag: F.max(F.when(F.col(flag), F.col("line_no"))).over(w)
    rows = rows.withColumns({"_run": F.sum(F.col("_starts").cast("int")).over(w), "_broken": F.coalesce(so_far("_bad") >= so_far("_starts"), F.lit(False))}).where("_run > 0")
    pair = Window.partitionBy(*key, "_run").orderBy("line_no")
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = lambda value, cond: F.collect_list(F.when(cond, value)).over(whole)
    rows = rows.select(*key, "_run", F.row_number().over(pair).alias("_at"), listed(F.trim("line"), ~F.col("_figures")).alias("_words"), listed(F.col("_read"), F.col("_figures") & ~F.col("_broken")).alias("_values"))
    pairs = rows.where("_at = 1").select(*key, "_run", "_words", F.flatten("_values").alias("values"))
    return pairs.where(F.size("values") > 0).select(*key, F.col("_run").alias("pair_no"), label_key(F.array_join("_words", " ")).alias("label"), "values")


def sections(lines: DataFrame, key: list[str], names: list[tuple[str, str, str | None]]) -> DataFrame:
    """Adds section: lines from the first that is exactly the start up to the next that is the end (names: section, start, end).

    Without an end, or where it doesn't come, a section goes to the last line. A text without the start has none of it;
    a line may lie in several sections."""
    whole = Window.partitionBy(*key)
    out = lines.withColumn("_key", label_key(F.col("line")))
    norm = lambda x: label_key(F.lit(x))
    first = {n: F.min(F.when(F.col("_key") == norm(a), F.col("line_no"))).over(whole) for n, a, _ in names}
    out = out.withColumns({f"_a{i}": first[n] for i, (n, _, _) in enumerate(names)})
    last = {f"_z{i}": F.min(F.when((F.col("_key") == norm(z)) & (F.col("line_no") > F.col(f"_a{i}")), F.col("line_no"))).over(whole) if z else F.lit(None).cast("int") for i, (_, _, z) in enumerate(names)}
    out = out.withColumns(last)
    inside = [F.when((F.col("line_no") >= F.col(f"_a{i}")) & F.coalesce(F.col("line_no") < F.col(f"_z{i}"), F.lit(True)), F.lit(n)) for i, (n, _, _) in enumerate(names)]
    return out.withColumn("section", F.explode(F.array_compact(F.array(*inside)))).select(*lines.columns, "section")


def by_label(pairs: DataFrame, key: list[str], wanted: list[tuple[str, int, str, int, bool]]) -> DataFrame:
    """(key, name, value, label): the figure of each name (wanted: name, priority, label, column, add all) by the first label that gives one.

    Pairs whose label is exactly it count; only if there is none, those whose label ends in it. The first pair's column
    is taken, counted from 0, -1 being the last; or all pairs' are added. A pair without that column gives nothing."""
    spec = pairs.sparkSession.createDataFrame(wanted, "name string, priority int, asked string, at int, add_all boolean").withColumn("_asked", label_key(F.col("asked")))
    exact, suffix = F.col("label") == F.col("_asked"), F.col("label").endswith(F.concat(F.lit(" "), F.col("_asked")))
    met = pairs.join(F.broadcast(spec), exact | suffix).withColumn("_suffix", (~exact).cast("int"))
    value = F.try_element_at("values", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") + 1))
    per = met.groupBy(*key, "name", "priority", "asked", "add_all", "_suffix").agg(F.min(F.struct("pair_no", value.alias("v"))).alias("_first"), F.sum(value.cast("decimal(38,6)")).cast("double").alias("_sum"))
    best = per.withColumn("_least", F.min("_suffix").over(Window.partitionBy(*key, "name", "priority"))).where("_suffix = _least")
    told = best.withColumn("value", F.when(F.col("add_all"), F.coalesce("_sum", F.lit(0.0))).otherwise(F.col("_first.v"))).where("value IS NOT NULL")
    return told.groupBy(*key, "name").agg(F.min(F.struct("priority", "value", F.col("asked").alias("label"))).alias("_b")).select(*key, "name", "_b.value", "_b.label")


def section_totals(lines: DataFrame, document: list[str], page: str, names: list[tuple[str, str, str | None]], sets: list[list[str]]) -> DataFrame:
    """(document, section, total, parts): over all pages, the last columns of the labels of the first set that a page's section has any of."""
    key = [*document, page]
    inside = sections(lines, key, names)
    pairs = folded(inside, [*key, "section"])
    wanted = [(f"{i}:{label}", 0, label, -1, False) for i, labels in enumerate(sets) for label in labels]
    found = by_label(pairs, [*key, "section"], wanted).withColumn("_set", F.substring_index("name", ":", 1).cast("int"))
    first = found.withColumn("_first", F.min("_set").over(Window.partitionBy(*key, "section"))).where("_set = _first")
    return first.groupBy(*document, "section").agg(F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 6).alias("total"), F.count("*").alias("parts"))


def suffix_totals(pairs: DataFrame, key: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """(key, name, total, parts): the last figures of the labels that end in one of a name's codes, added; a label counts once a name. Names without any give no row."""
    low = {n: [x.lower() for x in codes] for n, codes in groups.items()}
    fits = lambda codes: F.exists(F.array(*[F.lit(x) for x in codes]), lambda x: F.col("label").endswith(x))
    names = F.explode(F.array_compact(F.array(*[F.when(fits(codes), F.lit(n)) for n, codes in low.items()])))
    rows = pairs.select(*key, names.alias("name"), F.element_at("values", -1).alias("v"))
    return rows.groupBy(*key, "name").agg(F.round(F.sum(F.col("v").cast("decimal(38,6)")).cast("double"), 6).alias("total"), F.count("*").alias("parts"))


def detached_signs(lines: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, value): the figure after the first line that is the label, where its minus signs stand on lines of their own.

    Only the exact form counts: figure, minus, the same figure, minus. Anything else gives null, for a lone minus may as
    well be an empty cell; texts without the label give no row."""
    w = Window.partitionBy(*key).orderBy("line_no")
    rows = lines.where(F.trim("line") != "").select(*key, "line_no", F.trim("line").alias("_t"))
    rows = rows.withColumns({f"_{i}": F.lead("_t", i).over(w) for i in range(1, 5)}).where(F.col("_t") == label)
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    exact = (F.col("_2") == "-") & (F.col("_4") == "-") & (F.col("_1") == F.col("_3"))
    return first.select(*key, F.when(exact, -parse_number(F.col("_1"))).alias("value"))


def with_total_column(lines: DataFrame, key: list[str], total: str, before: str) -> DataFrame:
    """(key, has_total): does a line that is the total's heading come before the first line that starts with ``before``? Without such a line anywhere will do."""
    norm = label_key(F.col("line"))
    at = F.min(F.when(norm == label_key(F.lit(total)), F.col("line_no")))
    stop = F.min(F.when(norm.startswith(before.lower()), F.col("line_no")))
    return lines.groupBy(*key).agg(at.alias("_a"), stop.alias("_s")).select(*key, F.coalesce(F.col("_a") < F.coalesce("_s", F.lit(2**31 - 1)), F.lit(False)).alias("has_total"))
