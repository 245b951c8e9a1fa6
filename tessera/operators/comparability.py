"""Which companies may fairly be compared, how they rank, and what deserves an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"C": 0, "NA": 1, "R": 2, "N": 3}


def group_key() -> Column:
    return F.concat_ws(" · ", "activity", "model", "perimeter")


def peer_groups(companies: DataFrame, small: int = 5) -> DataFrame:
    g = companies.groupBy(group_key().alias("peer_group")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"))
    return g.withColumn("small_sample", F.col("n") < small)


def sort_value(value: Column, sense: str) -> Column:
    """What ranks lowest first: higher or lower is better, nearest to zero, or neutral (as higher)."""
    return {"higher": -value, "lower": value, "zero": F.abs(value)}.get(sense, -value)


def peer_rank(rows: DataFrame, sense: str, least: int = 5) -> DataFrame:
    """(peer_group, company_id, value): rank in the group, ties sharing the best; percentile null if neutral.

    Groups of fewer than ``least`` members or values give a reason in place of a rank."""
    by = Window.partitionBy("peer_group")
    size, known = F.count("*").over(by), F.count("value").over(by)
    rank = F.rank().over(by.orderBy(sort_value(F.col("value"), sense).asc_nulls_last()))
    df = rows.withColumns({"_n": size, "_k": known, "_r": rank})
    reason = F.when(F.col("_n") < least, "group too small").when(F.col("value").isNull(), "no value").when(F.col("_k") < least, "too few values")
    fine = reason.isNull()
    percentile = F.lit(None).cast("double") if sense == "neutral" else F.floor((F.col("_k") - F.col("_r")) / (F.col("_k") - 1) * 100 + 0.5).cast("double")
    return df.select("peer_group", "company_id", "value", F.when(fine, F.col("_r")).alias("rank"), F.when(fine, percentile).alias("percentile"), reason.alias("reason"))


def comparative_rank(rows: DataFrame, by: list[str], sense: str = "higher") -> DataFrame:
    """Competition rank among non-null values; best is rank 1, worst a rank equal to the number of values, over 1."""
    w = Window.partitionBy(*by)
    known = rows.where("value IS NOT NULL")
    df = known.withColumn("rank", F.rank().over(w.orderBy(sort_value(F.col("value"), sense)))).withColumn("_n", F.count("*").over(w))
    return df.withColumn("best", F.col("rank") == 1).withColumn("worst", (F.col("rank") == F.col("_n")) & (F.col("_n") > 1)).drop("_n")


def standing(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Place in the group by descending value, ties by input order; percentile 100 if alone; and the group's median."""
    w = Window.partitionBy(*by)
    known = rows.where("value IS NOT NULL")
    df = known.withColumn("place", F.row_number().over(w.orderBy(F.desc("value"), order))).withColumn("n", F.count("*").over(w)).withColumn("median", F.median("value").over(w))
    return df.withColumn("percentile", F.when(F.col("n") == 1, 100.0).otherwise(F.floor((F.col("n") - F.col("place")) / F.greatest(F.col("n") - 1, F.lit(1)) * 100 + 0.5).cast("double")))


def closest_in_size(rows: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(peer_group, company_id, size): for each reference company its k nearest in size within the group.

    Different sizes are ordered once in each group; candidates are the k + 1 first companies of each of the k sizes on
    either side of the reference's and of its own, so no pair join, and equal sizes don't hide each other."""
    sized = rows.where("size IS NOT NULL").withColumn("pos", F.dense_rank().over(Window.partitionBy("peer_group").orderBy("size")))
    few = sized.withColumn("_r", F.row_number().over(Window.partitionBy("peer_group", "pos").orderBy("company_id"))).where(F.col("_r") <= k + 1).drop("_r")
    marks = sized.join(reference.select("company_id"), "company_id").select("peer_group", F.col("company_id").alias("ref"), F.col("size").alias("ref_size"), F.col("pos").alias("ref_pos"))
    near = marks.withColumn("pos", F.explode(F.sequence(F.col("ref_pos") - k, F.col("ref_pos") + k))).join(few, ["peer_group", "pos"]).where("company_id <> ref")
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy(F.abs(F.col("size") - F.col("ref_size")), "company_id")))
    return ranked.where(F.col("place") <= k).select("ref", "company_id", "place", F.round(F.abs(F.col("size") - F.col("ref_size")), 4).alias("gap"))


def compatibility(selection: DataFrame, matrix: DataFrame, axes: list[str]) -> DataFrame:
    """(selection columns axes), (kpi_name, axis, verdict): for each selection and KPI the worst verdict over the axes it differs on."""
    differ = selection.groupBy("selection").agg(*[(F.count_distinct(a) > 1).alias(a) for a in axes])
    split = differ.select("selection", F.explode(F.filter(F.array(*[F.when(F.col(a), F.lit(a)) for a in axes]), lambda x: x.isNotNull())).alias("axis"))
    level = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    worst = split.join(matrix, "axis").groupBy("selection", "kpi_name").agg(F.max(level[F.col("verdict")]).alias("s"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("verdict") != "C", F.col("axis")))), ",").alias("axes"))
    all_pairs = selection.select("selection").distinct().crossJoin(F.broadcast(matrix.select("kpi_name").distinct()))
    names = F.array(*[F.lit(k) for k in SEVERITY])
    return all_pairs.join(worst, ["selection", "kpi_name"], "left").select("selection", "kpi_name", names[F.coalesce("s", F.lit(0))].alias("verdict"), F.coalesce("axes", F.lit("")).alias("axes"))


def majority_perimeter(selection: DataFrame) -> DataFrame:
    """The perimeter most of a selection has; solo on ties."""
    return selection.groupBy("selection").agg(F.when(F.count_if(F.col("perimeter") == "group") > F.count_if(F.col("perimeter") == "solo"), "group").otherwise("solo").alias("majority"))


def without_double_counts(rows: DataFrame) -> DataFrame:
    """Rows of a selection whose consolidating parent isn't in it too."""
    parents = rows.select(F.col("selection"), F.col("company_id").alias("parent_id")).distinct()
    return rows.join(parents, ["selection", "parent_id"], "left_anti")


def panel(rows: DataFrame) -> DataFrame:
    """Mean and median of a selection's values: no warned ones, none that a parent counts too, majority perimeter only."""
    kept = without_double_counts(rows.where(~F.col("warned") & F.col("value").isNotNull())).join(majority_perimeter(rows), "selection").where("perimeter = majority")
    return kept.groupBy("selection").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("decimal(20,8)")), 4).cast("double").alias("mean"), F.median("value").alias("median"))


def alerts(wide_rows: DataFrame) -> DataFrame:
    """Rule alerts of a company and year, level 1 danger, 2 attention, 3 information; missing inputs give none.

    Three rules are on the ratio without long-term measures: under 100 without them, over 50 points of impact, a transitional one."""
    c = F.col
    quality = F.try_divide(c("tier2") + c("tier3"), c("scr_total")) * 100
    rules = [("below_requirement", 1, c("ratio_scr") < 100), ("near_requirement", 2, (c("ratio_scr") >= 100) & (c("ratio_scr") < 130)), ("low_quality_capital", 2, quality >= 49.5), ("minimum_above_requirement", 1, c("mcr") >= c("scr_total")), ("absolute_floor", 3, F.try_divide("mcr", "scr_total") * 100 > 45.6)]
    if "ratio_without" in wide_rows.columns:
        rules += [("below_without_measures", 1, (c("ratio_without") < 100) & (c("ratio_scr") >= 100)), ("large_impact", 2, c("impact_all") <= -50), ("transitional_measure", 3, c("impact_tr").isNotNull())]
    fired = F.filter(F.array(*[F.when(x, F.struct(F.lit(n).alias("rule"), F.lit(v).alias("level"))) for n, v, x in rules]), lambda x: x.isNotNull())
    return wide_rows.select("company_id", "year", F.explode(fired).alias("a")).select("company_id", "year", "a.rule", "a.level")


def light(ratio: Column) -> Column:
    return F.when(ratio < 100, "danger").when(ratio < 200, "warning").when(ratio.isNotNull(), "good")


def loss_class(kpi: Column, axis: Column, activity: Column, classes: dict[str, str]) -> Column:
    """What is compared on an axis: for claims the activity's class, for all else the activity itself."""
    table = F.create_map(*[F.lit(x) for p in classes.items() for x in p])
    return F.when((kpi == "claims") & (axis == "activity"), F.coalesce(table[activity], activity)).otherwise(activity)


def common_group(selection: DataFrame) -> DataFrame:
    """The peer group that all of a selection share, or null."""
    return selection.groupBy("selection").agg(F.when(F.count_distinct("peer_group") == 1, F.min("peer_group")).alias("common"))


def warning_text(selection: DataFrame) -> DataFrame:
    """Why the companies of a selection compare badly: models, life with non-life, solo with group; null if nothing is mixed."""
    g = selection.groupBy("selection").agg((F.count_distinct("model") > 1).alias("m"), (F.bool_or(F.col("activity") == "life") & F.bool_or(F.col("activity") == "non-life")).alias("a"), (F.count_distinct("perimeter") > 1).alias("p"))
    text = F.concat_ws(" ", F.when(F.col("m"), "Different capital models."), F.when(F.col("a"), "Life and non-life mixed."), F.when(F.col("p"), "Solo and group entities mixed."))
    return g.select("selection", F.when(text != "", text).alias("warning"))


def sentiment(variation: Column, sense: str | None, unit: str) -> Column:
    """Better, worse or stable; neutral for an indicator without a sense."""
    if sense is None:
        return F.when(variation.isNotNull(), "neutral")
    good = variation > 0 if sense == "higher" else variation < 0
    return F.when(F.abs(variation) < (0.5 if unit == "pts" else 0.01), "stable").when(good, "better").when(variation.isNotNull(), "worse")


def radar(shares: DataFrame, axes: list[str]) -> DataFrame:
    """Companies that have a share on every axis, and the selection's scale: the greatest share rounded up to ten, 10 to 100."""
    w = shares.groupBy("selection", "company_id").agg(*[F.max(F.when(F.col("module") == a, F.col("share"))).alias(a) for a in axes])
    whole = w.where(" AND ".join(f"{a} IS NOT NULL" for a in axes))
    return whole.groupBy("selection").agg(F.count("*").alias("companies"), F.least(F.lit(100.0), F.greatest(F.lit(10.0), F.ceil(F.max(F.greatest(*axes)) / 10) * 10.0)).alias("scale"))


def breakdown(rows: DataFrame, parts: list[str], total: str, warned: Column) -> DataFrame:
    """The parts of a total as lines, and the adjustment that is left where it is 1 % or more and nothing is warned of."""
    rest = F.col(total)
    for p in parts:
        rest = rest - F.coalesce(p, F.lit(0.0))
    lines = [F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("line"), F.col(p).alias("value"))) for p in parts]
    lines.append(F.when((F.abs(rest) >= 0.01 * F.abs(total)) & ~warned, F.struct(F.lit("adjustment").alias("line"), rest.alias("value"))))
    return rows.select("company_id", "year", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("l")).select("company_id", "year", "l.*")


def publication(with_measures: Column, without: Column, used: Column) -> Column:
    """What a two-ended bar shows: both ends, one since no measure is used, or nothing."""
    return F.when(used & without.isNotNull() & with_measures.isNotNull(), "published").when(~used & with_measures.isNotNull(), "none").otherwise("unavailable")


def axis_bounds(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Least and greatest of an axis that shows all values, zero and the threshold."""
    return rows.groupBy(*by).agg(F.least(F.lit(0.0), F.lit(threshold), F.min("value")).alias("low"), F.greatest(F.lit(0.0), F.lit(threshold), F.max("value")).alias("high"))


def atypical(kpi: Column, perimeter: Column, value: Column, low: float, high: float) -> Column:
    """A warning on a value: a minimum requirement of a group has another meaning, and one far outside the range is atypical."""
    return F.when((kpi == "mcr") & (perimeter == "group"), "group minimum").when((value < low) | (value > high), "atypical")


def area_shares(rows: DataFrame, value: str) -> DataFrame:
    """(company_id, value, share): percent of all areas, without companies whose consolidating parent is shown too."""
    kept = without_double_counts(rows.withColumn("selection", F.lit(0))).where(F.col(value) > 0)
    total = kept.agg(F.sum(F.col(value).cast("decimal(38,8)")).cast("double").alias("_s"))  # one row
    return kept.crossJoin(F.broadcast(total)).select("company_id", value, F.round(F.col(value) / F.col("_s") * 100, 4).alias("share"))
