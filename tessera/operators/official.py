"""Computed indicators with their lineage: each value with its formula, its components, a recomputation and what follows for its validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_ratio, units
from tessera.operators.indicators import KEY

INPUTS = ["own_funds", "scr_total", "ratio_scr", "best_estimate", "risk_margin", "mcr", "premiums"]
NAMES = ["ratio_scr_without_lt", "impact_va", "impact_transitional", "margin_on_estimate", "mcr_pct_of_scr", "loss_ratio"]
COMPONENT = "struct<label:string,value:double,unit:string,operation:string,kpi_code:string,page:int,valid:boolean,warning:string>"
NONE, ADJUSTMENT, STEPS = "No long-term measure is in use.", "No transitional measure: only the adjustment is taken away.", "Stepwise: the transitional measure goes first, then the adjustment."
MISMATCH = "The components give another value: to be checked."


def _part(label: str, value: Column, unit: str, operation: str, valid: Column, page: Column, kpi: str | None = None, warning: Column | None = None) -> Column:
    fields = [F.lit(label), value, F.lit(unit), F.lit(operation), F.lit(kpi), page, valid, F.lit(None) if warning is None else warning]
    names = [x.split(":")[0] for x in COMPONENT[7:-1].split(",")]
    return F.struct(*[f.alias(n) for f, n in zip(fields, names)]).cast(COMPONENT)


def _kpi(name: str, label: str, operation: str, value: Column | None = None) -> Column:
    """A component that is a reported figure."""
    k = F.col(name)
    return _part(label, k["value"] if value is None else value, "pct" if name == "ratio_scr" else "MEUR", operation, k["validated"], k["source_page"], name, k["warning"])


def _indicator(name: str, value: Column, kind: str, text: str, factor: int, note: Column | str | None, parts: list[Column], given: Column) -> Column:
    row = F.struct(F.lit(name).alias("kpi_name"), value.cast("double").alias("value"), F.lit(kind).alias("type"), F.lit(text).alias("text"), F.lit(float(factor)).alias("factor"), (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("remark"), F.array_compact(F.array(*parts)).alias("components"))
    return F.when(given & value.isNotNull(), row)


def inputs(kpis: DataFrame) -> DataFrame:
    """One row a company and year with a struct (value, validated, source_page, warning) for each input; null where there is no value."""
    got = kpis.where(F.col("value").isNotNull() & F.col("kpi_name").isin(*INPUTS))
    of = F.struct("value", "validated", "source_page", "warning")
    return got.groupBy(*KEY).agg(*[F.max(F.when(F.col("kpi_name") == n, of)).alias(n) for n in INPUTS])


def worked_out(rows: DataFrame, m: str = "m") -> DataFrame:
    """Adds what the indicators are made of, each a column that is worked out once a row: whole units, sums, ratios (null where not asked)."""
    c, of, one = F.col, lambda x: F.col(f"{m}.{x}"), F.lit(10**8).cast("decimal(20,0)")
    effects = {"_fp": "fp_with", "_scr": "scr_with", "_dfv": "d_fp_va", "_dsv": "d_scr_va", "_dft": "d_fp_tr", "_dst": "d_scr_tr"}
    table = c(m).isNotNull() & of("published_ratio").isNull() & of("fp_with").isNotNull()
    able = table & c("own_funds").isNotNull() & c("scr_total").isNotNull()
    x = rows.withColumns({"_table": table, "_able": able, "_published": units(of("published_ratio")), "_ratio": units(c("ratio_scr.value"))})
    x = x.withColumns({k: F.when(c("_able"), units(F.coalesce(of(v), F.lit(0.0)))) for k, v in effects.items()})
    agrees = (F.abs(units(of("fp_with")) - units(c("own_funds.value"))) <= 10**6) & (F.abs(units(of("scr_with")) - units(c("scr_total.value"))) <= 10**6)
    x = x.withColumns({"_agrees": F.coalesce(F.when(c("_able"), agrees), F.lit(False)), "_n": c("_fp") + c("_dft") + c("_dfv"), "_d": c("_scr") + c("_dst") + c("_dsv"), "_n1": c("_fp") + c("_dft"), "_d1": c("_scr") + c("_dst")})
    gap = lambda n, d, n0, d0: exact_ratio(c(n) * c(d0) - c(n0) * c(d), c(d) * c(d0), 100, 1)
    ratio = lambda n, d, digits: exact_ratio(c(n), c(d), 100, digits)
    both = F.coalesce((c("mcr.value") != 0) & (c("scr_total.value") != 0) & c("solo"), F.lit(False))
    on = lambda a, b: exact_ratio(units(c(f"{a}.value")), units(c(f"{b}.value")), 100, 2)
    told = c(m).isNotNull() & of("published_ratio").isNotNull()
    x = x.withColumns({
        "_told": F.when(told, exact_ratio(c("_published"), one, 1, 1)), "_told_gap": F.when(told, exact_ratio(c("_published") - c("_ratio"), one, 1, 1)),
        "_without": ratio("_n", "_d", 1), "_impact": gap("_n", "_d", "_n1", "_d1"), "_step_gap": gap("_n1", "_d1", "_fp", "_scr"),
        "_step0": ratio("_n", "_d", 4), "_step1": ratio("_n1", "_d1", 4), "_step2": ratio("_fp", "_scr", 4),
        "_margin": on("risk_margin", "best_estimate"), "_both": both, "_mcr": F.when(both, on("mcr", "scr_total")),
    })
    total = lambda kind: F.aggregate(_own(kind), F.lit(0).cast("decimal(38,0)"), lambda a, r: (a + units(r["value"])).cast("decimal(38,0)"))
    return x.withColumns({"_premium": total("premium"), "_claim": total("claim")})


def _own(kind: str, lines: str = "lines") -> Column:
    """Lines of a kind and of class non-life."""
    return F.filter(F.coalesce(F.col(lines), F.expr("array()")), lambda r: (r["kind"] == kind) & (r["class"] == "non-life"))


def long_term(m: str = "m") -> list[Column]:
    """The ratio without long-term measures and what the measures are worth, by one of three ways: the company publishes the
    ratio; it uses no measure; or a table gives the effects, taken away stepwise.

    Steps have four decimals in the components, the results one. Components from the table are valid if its amounts are
    the reported ones, to 0.01; a published ratio is never valid by itself."""
    c, of = F.col, lambda x: F.col(f"{m}.{x}")
    there, page = c(m).isNotNull(), of("source_page")
    ratio, published = c("ratio_scr.value"), of("published_ratio")
    told, none = there & published.isNotNull(), there & published.isNull() & of("fp_with").isNull()
    without, impact = "ratio_scr_without_lt", "impact_va"
    rows = [
        _indicator(without, c("_told"), "difference", "Ratio without adjustment, as published", 1, None, [_part("Published ratio without adjustment", published, "pct", "+", F.lit(False), page)], told),
        _indicator(impact, c("_told_gap"), "difference", "Ratio without measures - published ratio", 1, None, [_part("Ratio without measures", published, "pct", "+", F.lit(False), page, without), _kpi("ratio_scr", "Published ratio", "-")], told & ratio.isNotNull() & (ratio != 0)),
        _indicator(without, ratio, "difference", "Published ratio, nothing to take away", 1, NONE, [_kpi("ratio_scr", "Published ratio", "+")], none),
        _indicator(impact, F.lit(0.0), "difference", "Ratio without measures - published ratio", 1, NONE, [_part("Ratio without measures", ratio, "pct", "+", c("ratio_scr.validated"), c("ratio_scr.source_page"), without, c("ratio_scr.warning")), _kpi("ratio_scr", "Published ratio", "-")], none & ratio.isNotNull()),
    ]
    steps = F.coalesce(of("transitional"), F.lit(False))
    agrees, able = c("_agrees"), c("_able")
    effect = lambda label, x, op, when=F.lit(True): F.when(when, _part(label, of(x), "MEUR", op, agrees, page))
    parts = [
        _kpi("own_funds", "Own funds", "num", of("fp_with")), effect("Transitional measure, own funds", "d_fp_tr", "num", steps), effect("Adjustment, own funds", "d_fp_va", "num"),
        _kpi("scr_total", "Requirement", "den", of("scr_with")), effect("Transitional measure, requirement", "d_scr_tr", "den", steps), effect("Adjustment, requirement", "d_scr_va", "den"),
    ]
    own_valid = c("own_funds.validated") & c("scr_total.validated") & agrees
    remark = F.when(steps, STEPS).otherwise(ADJUSTMENT)
    step = lambda label, x, op, valid, kpi=None: _part(label, c(x), "pct", op, valid, page, kpi)
    rows.append(_indicator(without, c("_without"), "ratio", "(own funds + effects) / (requirement + effects) * 100", 100, remark, parts, able))
    rows.append(_indicator(impact, c("_impact"), "difference", "Ratio without measures - ratio before the adjustment goes", 1, remark, [step("Ratio without measures", "_step0", "+", own_valid, without), step("Ratio before the adjustment goes", "_step1", "-", agrees)], able))
    rows.append(_indicator("impact_transitional", c("_step_gap"), "difference", "Ratio without transitional measure - published ratio", 1, None, [step("Ratio without transitional measure", "_step1", "+", agrees), step("Ratio with measures", "_step2", "-", agrees)], able & steps))
    return rows


def simple() -> list[Column]:
    """Risk margin over best estimate; the minimum requirement in percent of the full one, of solo companies (column solo)."""
    c = F.col
    return [
        _indicator("margin_on_estimate", c("_margin"), "ratio", "risk margin / best estimate * 100", 100, None, [_kpi("risk_margin", "Risk margin", "num"), _kpi("best_estimate", "Best estimate", "den")], F.lit(True)),
        _indicator("mcr_pct_of_scr", c("_mcr"), "ratio", "MCR / SCR * 100", 100, None, [_kpi("mcr", "MCR", "num"), _kpi("scr_total", "SCR", "den")], c("_both")),
    ]


def loss_ratio(lines: str = "lines", least: int = 10) -> Column:
    """Claims over premiums of the lines (kind, label, class, value, page, idx, reread) of class non-life.

    Not computed if any line has no class, or the class's premiums are under ``least`` or under a tenth of the company's."""
    x = F.coalesce(F.col(lines), F.expr("array()"))
    own = lambda kind: _own(kind, lines)
    premium, claim = F.col("_premium"), F.col("_claim")
    given = lambda kind: F.exists(x, lambda r: r["kind"] == kind)
    fine = given("premium") & given("claim") & ~F.exists(x, lambda r: r["class"].isNull()) & (premium >= least * 10**8) & (premium * 10 >= units(F.col("premiums.value")))
    part = lambda op: lambda r: F.struct(r["label"], r["value"], F.lit("MEUR"), F.lit(op), F.lit(None), r["page"], r["reread"], F.lit(None)).cast(COMPONENT)
    parts = F.concat(F.transform(own("claim"), part("num")), F.transform(own("premium"), part("den")))
    row = F.struct(F.lit("loss_ratio").alias("kpi_name"), exact_ratio(claim, premium, 100, 1).alias("value"), F.lit("ratio").alias("type"), F.lit("non-life claims / non-life premiums * 100").alias("text"), F.lit(100.0).alias("factor"), F.lit("Non-life lines only.").alias("remark"), parts.alias("components"))
    return F.when(F.coalesce(fine, F.lit(False)), row)


def finalised(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Adds recomputed, valid, warned and note to indicators (value, type, factor, components).

    A value is valid if its components give it, to the tolerance, and all of them are valid. Warnings of components,
    each once and in order, and a failed recomputation make its note."""
    total = lambda ops: F.aggregate(F.filter("components", lambda p: p["operation"].isin(*ops)), F.lit(0).cast("decimal(38,0)"), lambda a, p: (a + units(p["value"])).cast("decimal(38,0)"))
    one = F.lit(10**8).cast("decimal(20,0)")
    plain = exact_ratio(total(["+"]) - total(["-"]), one, 1, 4) * F.col("factor")
    again = F.when(F.col("type") == "ratio", exact_ratio(total(["num"]), total(["den"]), 100, 4)).otherwise(plain)
    ok = F.coalesce(F.abs(F.col("recomputed") - F.col("value")) <= tolerance + 1e-9, F.lit(False))
    notes = F.array_distinct(F.filter(F.transform("components", lambda p: p["warning"]), lambda w: w.isNotNull()))
    df = rows.withColumn("recomputed", again).withColumn("_notes", F.concat(notes, F.when(ok, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit(MISMATCH)))))
    valid = ok & F.forall("components", lambda p: F.coalesce(p["valid"], F.lit(False)))
    return df.withColumns({"valid": valid, "warned": F.size("_notes") > 0, "note": F.when(F.size("_notes") > 0, F.array_join("_notes", " "))}).drop("_notes")


def official(kpis: DataFrame, measures: DataFrame, lines: DataFrame, solo: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The six computed indicators of each company and year that has what they need.

    kpis: (company_id, year, kpi_name, value, validated, source_page, warning); measures: one row a company and year;
    lines: premium and claim lines; solo: company_ids. Returns company_id, year, kpi_name, value, type, text, factor,
    remark, components, recomputed, valid, warned, note."""
    line = lines.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "label", "class", "value", "page", "reread"))).alias("lines"))
    m = measures.select(*KEY, F.struct(*[F.col(x) for x in measures.columns if x not in KEY]).alias("m"))
    alone = solo.select("company_id", F.lit(True).alias("solo")).distinct()
    rows = inputs(kpis).join(m, KEY, "left").join(line, KEY, "left").join(alone, "company_id", "left").withColumn("solo", F.coalesce("solo", F.lit(False)))
    found = F.array_compact(F.array(*long_term(), *simple(), loss_ratio()))
    return finalised(worked_out(rows).select(*KEY, F.explode(found).alias("r")).select(*KEY, "r.*"), tolerance)


def components_of(indicators: DataFrame) -> DataFrame:
    """One row a component: key, indicator, place from 1 on, and the component's fields."""
    rows = indicators.select(*KEY, "kpi_name", F.posexplode("components").alias("place", "p"))
    return rows.select(*KEY, "kpi_name", (F.col("place") + 1).alias("place"), "p.*")


def formulas_of(indicators: DataFrame) -> DataFrame:
    return indicators.select(*KEY, "kpi_name", "type", "text", "factor", F.col("remark"))


def with_computed(kpis: DataFrame, indicators: DataFrame) -> DataFrame:
    """The reported figures without earlier computed ones, then the new: (company_id, year, kpi_name, value, validated, warning)."""
    new = indicators.select(*KEY, "kpi_name", "value", F.col("valid").alias("validated"), F.col("note").alias("warning"))
    return kpis.where(~F.col("kpi_name").isin(*NAMES)).select(*KEY, "kpi_name", "value", "validated", "warning").unionByName(new)

