"""Tables whose rows should follow a reference list: labels checked, and two rows that were run together told apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_tokens

REPAIRED, SOUND, SCOPE = "repaired", "sound", "out of scope"


def matched(rows: DataFrame, reference: list[tuple[str, str]], stop: list[str] = ()) -> DataFrame:
    """(table, row_no, label) with matches, the places in ``reference`` (name, key) whose words the label holds side by side, and kind: total, empty, unknown, single or merged.

    A reference is a fixed list, told in the plan as words that were cut once; a label is cut once, too. A name whose words lie within a longer one that matches counts too."""
    padded = lambda x: F.when(F.size(x) > 0, F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" ")))
    names = rows.sparkSession.range(1).select(*[padded(name_tokens(F.lit(name), list(stop))).alias(f"n{i}") for i, (name, _) in enumerate(reference)]).first()
    sought = F.array(*[F.lit(n).cast("string") for n in names])
    text = F.trim(F.coalesce("label", F.lit("")))
    own = F.transform(F.array(name_tokens(F.coalesce("label", F.lit("")), list(stop))), lambda w: F.struct(F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first"), padded(w).alias("words")))
    held = lambda w: F.filter(F.transform(sought, lambda s, i: F.when(w["words"].contains(s), i)), lambda i: i.isNotNull())
    told = F.transform(own, lambda w: F.struct(held(w).alias("matches"), w["first"].alias("_first")))
    rows = rows.select("*", F.inline(told))  # a generator, so that no later filter or column does the work again
    n = F.size("matches")
    kind = F.when(F.col("_first") == "total", "total").when(text == "", "empty").when(n == 0, "unknown").when(n == 1, "single").otherwise("merged")
    return rows.withColumn("kind", kind).drop("_first")


def flagged_labels(rows: DataFrame) -> DataFrame:
    """Rows whose label matches nothing of the reference or several of it; totals are left out."""
    return rows.where("kind NOT IN ('total', 'single')").select("table_id", "row_no", "label", F.size("matches").alias("n"), "matches")


def diagnosed(rows: DataFrame, least: int) -> DataFrame:
    """One row a table: status, and where the empty and the merged row are and what they should be (places in the reference).

    In scope are tables with ``least`` single rows at least whose places go strictly up. Repaired is one empty row beside
    one merged one, between single rows whose places leave out exactly the two that the merged label names: the upper row
    is the first of them. Any other trouble is named and changes nothing."""
    single = F.col("kind") == "single"
    place = F.when(single, F.element_at("matches", 1))
    before = F.last(place, ignorenulls=True).over(Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1))
    at = lambda kind: F.when(F.col("kind") == kind, F.col("row_no"))
    whole = Window.partitionBy("table_id")
    ends = [F.min(at(k)).over(whole) for k in ("empty", "merged")]
    w = rows.drop("label").withColumns({"_place": place, "_ok": ~single | F.coalesce(place > before, F.lit(True)), "_lo": F.least(*ends), "_hi": F.greatest(*ends)})
    c = F.col
    context = [F.max(F.when(c("row_no") < c("_lo"), c("_place"))).alias("_before"), F.min(F.when(c("row_no") > c("_hi"), c("_place"))).alias("_after")]
    j = w.groupBy("table_id").agg(F.count_if(single).alias("_singles"), F.bool_and("_ok").alias("_rising"), *[F.count_if(c("kind") == k).alias(f"_{k}") for k in ("empty", "unknown", "merged")], F.min(at("empty")).alias("empty_row"), F.min(at("merged")).alias("merged_row"), F.max(F.when(c("kind") == "merged", c("matches"))).alias("_named"), *context)
    missing = F.array(c("_before") + 1, c("_before") + 2)
    status = (
        F.when(~c("_rising") | (c("_singles") < least), SCOPE).when((c("_empty") == 0) & (c("_merged") == 0) & (c("_unknown") == 0), SOUND).when(c("_unknown") > 0, "unknown label")
        .when((c("_empty") != 1) | (c("_merged") != 1), "not one empty and one merged row").when(F.abs(c("empty_row") - c("merged_row")) != 1, "not side by side")
        .when(c("_before").isNull() | c("_after").isNull(), "no row before or after").when(c("_after") - c("_before") != 3, "gap of other than two").when(F.array_sort("_named") != missing, "others than the gap").otherwise(REPAIRED)
    )
    good = c("status") == REPAIRED
    return j.withColumn("status", status).select("table_id", "status", F.when(good, c("empty_row")).alias("empty_row"), F.when(good, c("merged_row")).alias("merged_row"), F.when(good, c("_before") + 1).alias("first_place"))


def repaired(rows: DataFrame, found: DataFrame, reference: list[tuple[str, str]]) -> DataFrame:
    """(table_id, row_no, label) with the two labels of each repaired table in their places; other rows as they are."""
    names = F.array(*[F.lit(n) for n, _ in reference])
    fix = found.where(F.col("status") == REPAIRED).select("table_id", F.least("empty_row", "merged_row").alias("_upper"), "first_place")
    j = rows.join(fix, "table_id", "left")
    name: Column = F.when(F.col("row_no") == F.col("_upper"), F.get(names, F.col("first_place"))).when(F.col("row_no") == F.col("_upper") + 1, F.get(names, F.col("first_place") + 1))
    return j.select("table_id", "row_no", F.coalesce(name, "label").alias("label"), name.isNotNull().alias("repaired"))
