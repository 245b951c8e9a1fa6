"""Company indicators in long form: pivots, derived ratios, components with lineage, validation rules, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_ratio, units

KEY = ["company_id", "year"]


def wide(kpis: DataFrame, names: list[str], by: list[str] = KEY) -> DataFrame:
    """One row a key with a column for each name: one aggregation, no join for each."""
    return kpis.where(F.col("kpi_name").isin(*names)).groupBy(*by).agg(*[F.max(F.when(F.col("kpi_name") == n, F.col("value"))).alias(n) for n in names])


def ratio(a: Column, b: Column, digits: int, scale: float = 100.0) -> Column:
    """a / b * scale, null where either is null or b is 0."""
    return F.round(F.try_divide(a, b) * scale, digits) + 0.0


def ratios(kpis: DataFrame) -> DataFrame:
    """The normalised ratios of a company and year; each null unless all its inputs are there."""
    w = wide(kpis, ["own_funds", "tier1", "best_estimate", "risk_margin", "scr_total", "premiums"])
    c = F.col
    return w.select(*KEY, ratio(c("tier1"), c("own_funds"), 1).alias("tier1_share"), ratio(c("risk_margin"), c("best_estimate"), 2).alias("margin_on_estimate"), ratio(c("scr_total"), c("premiums") + c("best_estimate"), 2).alias("capital_intensity"))


def composition(kpis: DataFrame, modules: list[str], least: int = 1) -> DataFrame:
    """(company_id, year, module, share): percent of the modules' sum, where at least ``least`` are given and the sum is positive."""
    rows = kpis.where(F.col("kpi_name").isin(*modules) & F.col("value").isNotNull())
    sums = rows.groupBy(*KEY).agg(F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("total"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("total") > 0))
    return rows.join(sums, KEY).select(*KEY, F.col("kpi_name").alias("module"), (F.round(F.col("value") / F.col("total") * 100, 1) + 0.0).alias("share"))


def module_ratios(kpis: DataFrame, modules: list[str], diversification: str, operational: str, total: str, least: int = 4) -> DataFrame:
    """(company_id, year, n, diversification, adjustments) in percent, one decimal, exact.

    diversification (a negative figure) over the sum of the modules that are given, if that is positive; what neither
    modules, diversification nor operational risk explain of the total, over the total, if ``least`` modules are given."""
    w = wide(kpis, [*modules, diversification, operational, total])
    u = lambda x: units(F.col(x))
    sums = sum((F.coalesce(u(m), F.lit(0)) for m in modules[1:]), F.coalesce(u(modules[0]), F.lit(0)))
    n = sum((F.col(m).isNotNull().cast("int") for m in modules[1:]), F.col(modules[0]).isNotNull().cast("int"))
    w = w.withColumns({"_sum": sums, "n": n})
    spread = F.when(F.col("_sum") > 0, exact_ratio(-u(diversification), F.col("_sum"), 100, 1))
    rest = u(total) - F.col("_sum") - u(diversification) - u(operational)
    return w.select(*KEY, "n", spread.alias("diversification"), F.when((F.col("_sum") > 0) & (F.col("n") >= least) & (F.col(total) != 0), exact_ratio(rest, u(total), 100, 1)).alias("adjustments"))


def guarded_loss_ratio(components: DataFrame, least: float, share: float) -> DataFrame:
    """(company_id, year, class, premium, claim): claims over premiums of the class 'N'.

    Null if any component has no class, or the class's premiums are under ``least`` or under ``share`` of all."""
    own = F.col("class") == "N"
    g = components.groupBy(*KEY).agg(F.sum(F.when(own, F.col("premium"))).cast("double").alias("p"), F.sum(F.when(own, F.col("claim"))).cast("double").alias("c"), F.sum("premium").cast("double").alias("all"), F.bool_or(F.col("class").isNull()).alias("unclear"))
    fine = ~F.col("unclear") & (F.col("p") >= least) & (F.col("p") >= share * F.col("all"))
    return g.select(*KEY, F.when(fine, ratio(F.col("c"), F.col("p"), 1)).alias("loss_ratio"))


def minimum_position(kpis: DataFrame, solo: DataFrame) -> DataFrame:
    """Where the minimum requirement stands between its corridor's ends of 25 and 45 percent of the full one; of solo companies (company_id) only."""
    w = wide(kpis, ["mcr", "scr_total"]).join(solo.select("company_id"), "company_id", "left_semi")
    p = F.try_divide("mcr", "scr_total") * 100
    place = F.when(p.isNull(), None).when(F.abs(p - 25) < 0.6, "floor").when(F.abs(p - 45) < 0.6, "cap").when(p > 45.6, "absolute floor").otherwise("between")
    return w.select(*KEY, F.round(p, 2).alias("mcr_pct"), place.alias("position"))


def without_measures(measures: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Solvency ratio without long-term measures and what they are worth in points: the published ratio, none in use, or stepwise.

    Stepwise, the transitional measure is taken away first, then the adjustment: impact_va is between these two steps,
    impact_tr up to the first, given only where the measure is in use. Columns in ``carry`` stay."""
    c, zero = F.col, F.lit(0.0)
    part = lambda name: F.coalesce(c(name), zero)
    full = F.try_divide("fp_with", "scr_with") * 100
    first = F.try_divide(c("fp_with") + part("d_fp_tr"), c("scr_with") + part("d_scr_tr")) * 100
    last = F.try_divide(c("fp_with") + part("d_fp_tr") + part("d_fp_va"), c("scr_with") + part("d_scr_tr") + part("d_scr_va")) * 100
    published, used = c("published_without").isNotNull(), c("uses_va") | c("transitional")
    by = lambda pub, none, step: F.when(published, pub).when(~used, none).otherwise(F.round(step, 1) + 0.0)
    gap = F.round(c("published_without") - c("ratio_stored"), 1)
    return measures.select(*KEY, *carry, by(F.round("published_without", 1), c("ratio_stored"), last).alias("ratio_without"), by(gap, zero, last - first).alias("impact_va"), F.when(~published & used & c("transitional"), F.round(first - full, 1) + 0.0).alias("impact_tr"), by(gap, zero, last - full).alias("impact_all"), F.when(published, "published").when(~used, "none").otherwise("stepwise").alias("basis"))


def recomputed(components: DataFrame, formulas: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """Each formula's value from its components, the gap to the stored one, and whether it and all components are valid."""
    v, op = F.col("component_value"), F.col("operation")
    part = lambda *ops: F.sum(F.when(op.isin(*ops), F.when(op == "-", -v).otherwise(v)))
    sums = components.groupBy(*KEY, "kpi_name").agg(part("num").alias("num"), part("den").alias("den"), part("+", "-").alias("signed"), F.bool_and("valid").alias("all_valid"))
    value = F.when(F.col("type") == "ratio", F.try_divide("num", "den")).otherwise(F.col("signed")) * F.col("factor")
    out = sums.join(formulas, [*KEY, "kpi_name"]).join(stored, [*KEY, "kpi_name"]).withColumn("recomputed", F.round(value, 4))
    close = F.abs(F.col("recomputed") - F.col("value")) <= tolerance
    return out.select(*KEY, "kpi_name", "recomputed", "value", close.alias("ok"), (close & F.col("all_valid")).alias("valid"))


#: Rules by name: what is expected, what is computed, and when they agree. Nulls skip a rule.
def checks(kpis: DataFrame, ceilings: dict[str, float], floors: dict[str, float], signs: dict[str, int], beta: tuple[float, float]) -> DataFrame:
    """(company_id, year, check_name, expected, computed, passed): identities, recomputed ratios, order, signs, magnitudes."""
    c = F.col
    w = wide(kpis, ["technical_provisions", "best_estimate", "risk_margin", "own_funds", "tier1", "tier1_restricted", "tier2", "tier3", "scr_total", "mcr", "ratio_scr"])
    near = lambda a, b, t: F.abs(a - b) <= t
    tiers = c("tier1") + c("tier1_restricted") + c("tier2") + c("tier3")
    solvency = F.try_divide("own_funds", "scr_total") * 100
    rules = [
        ("identity_provisions", c("technical_provisions"), c("best_estimate") + c("risk_margin"), near(c("technical_provisions"), c("best_estimate") + c("risk_margin"), 0.5)),
        ("identity_own_funds", c("own_funds"), tiers, near(c("own_funds"), tiers, 0.5)),
        ("ratio_scr", c("ratio_scr"), F.when(tiers.isNotNull(), solvency), near(c("ratio_scr"), solvency, 1.0)),
        ("mcr_below_scr", c("scr_total"), c("mcr"), c("mcr") < c("scr_total")),
        ("plausible_estimate", F.lit(beta[1]), F.try_divide("best_estimate", "scr_total"), F.try_divide("best_estimate", "scr_total").between(*beta)),
    ]
    across = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), e.cast("double").alias("expected"), F.round(k, 8).alias("computed"), p.alias("passed")) for n, e, k, p in rules]))
    pivoted = w.select(*KEY, across.alias("r")).select(*KEY, "r.*").where(c("passed").isNotNull() & c("computed").isNotNull())
    limits = [(f"sign_{k}", k, F.lit(0.0), c("value") * s >= 0) for k, s in signs.items()] + [(f"ceiling_{k}", k, F.lit(v), F.abs("value") <= v) for k, v in ceilings.items()] + [(f"floor_{k}", k, F.lit(v), c("value") >= v) for k, v in floors.items()]
    single = F.explode(F.filter(F.array(*[F.when((c("kpi_name") == k) & c("value").isNotNull(), F.struct(F.lit(n).alias("check_name"), e.alias("expected"), c("value").alias("computed"), p.alias("passed"))) for n, k, e, p in limits]), lambda x: x.isNotNull()))
    return pivoted.unionByName(kpis.select(*KEY, single.alias("r")).select(*KEY, "r.*"))


def completeness(kpis: DataFrame, names: list[str]) -> DataFrame:
    rows = kpis.where(F.col("kpi_name").isin(*names)).groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("value").isNull(), F.col("kpi_name")))), ",").alias("missing"))
    return rows.withColumn("passed", (F.col("n_rows") == len(names)) & (F.col("n_null") == 0))


def validated_flags(kpis: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """A listed KPI is validated if all checks whose name holds its name passed; others keep their flag."""
    flags = found.groupBy(*KEY).agg(*[F.bool_and(F.when(F.col("check_name").contains(n), F.col("passed"))).alias(f"_ok_{i}") for i, n in enumerate(names)])
    # one narrow row a company and year is looked up, so that the long table needs neither a shuffle of its own nor a sort
    j = kpis.join(flags.hint("shuffle_hash"), KEY, "left")
    ok = F.coalesce(*[F.when(F.col("kpi_name") == n, F.col(f"_ok_{i}")) for i, n in enumerate(names)], F.col("validated")) if names else F.col("validated")
    return j.withColumn("validated", ok).select(*kpis.columns)


def consensus(sources: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """(key, source ordinal, value): of three sources the pair of smallest relative gap within ``tolerance`` percent; its first value.

    confidence is high if all three agree, partial for a pair, null for none."""
    from tessera.functions.numbers import relative_gap

    a, b = sources.alias("a"), sources.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    on = same[0]
    for x in same[1:]:
        on = on & x
    pairs = a.join(b, on & (F.col("a.ordinal") < F.col("b.ordinal"))).select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.ordinal").alias("i"), F.col("b.ordinal").alias("j"), F.col("a.value").alias("value"), F.round(relative_gap(F.col("a.value"), F.col("b.value")), 6).alias("gap"))
    near = F.col("gap") <= tolerance
    return pairs.groupBy(*key).agg(F.min(F.when(near, F.struct("gap", "i", "j", "value"))).alias("m"), F.count_if(near).alias("n")).select(*key, F.col("m.value").alias("value"), F.when(F.col("n") >= 3, "high").when(F.col("n") >= 1, "partial").alias("confidence"))


def total_excluded_sum(cells: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Sum of a row's cells without its total: the only cell, not 0, that equals the sum of the others, if there is just one."""
    g = cells.groupBy(*key).agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.sort_array(F.collect_list("value")).alias("v"))
    is_total = lambda x: (F.abs(x - (F.col("s") - x)) <= tolerance) & (x != 0)
    totals = F.filter("v", is_total)
    return g.select(*key, F.round(F.when((F.size(totals) == 1) & (F.col("n") > 1), F.col("s") - totals[0]).otherwise(F.col("s")), 4).alias("total"), (F.size(totals) == 1).alias("excluded"))


def guarded_sums(expected: DataFrame, cells: DataFrame, key: list[str], code: str) -> DataFrame:
    """Sums over expected codes with a label guard: strict fails on any missing row, empty cell or wrong label; tolerant reads an empty cell as 0."""
    j = expected.join(cells, [*key, code], "left")
    right, there = F.col("label") == F.col("expected_label"), F.col("label").isNotNull()
    all_right = F.bool_and(F.coalesce(right & there, F.lit(False)))
    total = F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4)
    return j.groupBy(*key).agg(F.when(all_right & (F.count_if(F.col("value").isNull()) == 0), total).alias("strict"), F.when(all_right, total).alias("tolerant"))


def first_success(variants: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Variants in priority order: the first whose cell is there under the label it expects gives the value."""
    hits = variants.join(cells, [*key, "code"]).where((F.col("label") == F.col("expected_label")) & F.col("value").isNotNull())
    return hits.groupBy(*key).agg(F.min(F.struct("priority", "code", "value")).alias("m"), F.count("*").alias("successes")).select(*key, "m.priority", "m.code", "m.value", "successes")
