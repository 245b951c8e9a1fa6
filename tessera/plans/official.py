"""Queries of the computed indicators: values, components and the warehouse with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import building, official
from tessera.operators.indicators import wide
from tessera.plans.fixtures import COMPANIES_SQL, KPIS_SQL, companies, kpis
from tessera.plans.queries import c, query
from tessera.session import table

KEYS = ["company_id", "year"]


def _cents(x):
    return F.floor(x * 100) / 100


def warned_kpis(spark, d) -> DataFrame:
    """The fixture's figures; two of them come with a warning for some companies."""
    warned = (c("company_id") % 23 == 0) & c("kpi_name").isin("mcr", "best_estimate")
    return kpis(spark, d).withColumn("warning", F.when(warned, F.concat(F.lit("Read from a summary: "), "kpi_name")))


def measures(spark, d) -> DataFrame:
    """By company: a published ratio, no measure, a table with or without a transitional measure (some unlike the reported figures), or no row."""
    w = wide(kpis(spark, d), ["own_funds", "scr_total", "ratio_scr", "tier2", "tier3"])
    k = c("company_id") % 8
    on = lambda cond, x: F.when(cond, x)
    tab, steps = k.between(3, 6), k == 6
    off = F.when(c("company_id") % 10 == 3, 0.02).otherwise(0.0)
    out = w.where(k < 7).select(*KEYS, on(k == 0, _cents(c("ratio_scr") - c("company_id") % 30)).alias("published_ratio"), on(tab, _cents(c("own_funds")) + off).alias("fp_with"), on(tab, _cents(c("scr_total"))).alias("scr_with"), on(tab, -_cents(c("tier2") / 10)).alias("d_fp_va"), on(tab, _cents(c("scr_total") / 50)).alias("d_scr_va"), on(steps, -_cents(c("tier3") / 20)).alias("d_fp_tr"), on(steps, _cents(c("scr_total") / 80)).alias("d_scr_tr"), steps.alias("transitional"), (c("company_id") % 30 + 2).cast("int").alias("source_page"))
    return out


def lines(spark, d) -> DataFrame:
    """Premium and claim lines by order priority, classed by code or words; the last has neither for some companies."""
    o = table(spark, d, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    g = o.groupBy(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year"), level.alias("level")).agg((F.count("*") * 10.0).alias("premium"), F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("t"))
    code = F.when(c("level") == 1, "R0210").when(c("level") == 2, "R1510")
    label = F.when(c("level") < 3, "line").when(c("level") == 3, "Non-life, direct").when(c("level") == 4, "Life, direct").when(c("company_id") % 9 == 0, "other").otherwise("Health, non-life")
    kind = building.component_class(code, label, "non-life", "life", {"R0210": "non-life", "R1510": "life"})
    both = F.explode(F.array(F.struct(F.lit("premium").alias("kind"), c("premium").alias("value")), F.struct(F.lit("claim").alias("kind"), _cents(c("t") / 20000).alias("value"))))
    rows = g.select("*", label.alias("label"), kind.alias("class"), both.alias("b")).select(*KEYS, "level", "label", "class", "b.*")
    return rows.select(*KEYS, "kind", c("level").alias("idx"), "label", "class", "value", (c("level") + 10).alias("page"), ((c("level") + c("company_id")) % 4 != 0).alias("reread"))


def indicators(spark, d) -> DataFrame:
    solo = companies(spark, d).where("perimeter = 'solo'").select("company_id")
    return official.official(warned_kpis(spark, d), measures(spark, d), lines(spark, d), solo)


def _u(x: str) -> str:
    return f"floor(({x}) * 1e8::DOUBLE + 0.5)::HUGEINT"


def _r(a: str, b: str, factor: int, digits: int) -> str:
    return f"((CASE WHEN (({a}) < 0) <> (({b}) < 0) THEN -1 ELSE 1 END) * ((abs({a}) * {2 * factor * 10**digits} + abs({b})) // nullif(2 * abs({b}), 0)) / {10**digits}::DOUBLE)"


_ONE = "100000000::HUGEINT"
_FP, _SCR, _DFV, _DSV, _DFT, _DST = (_u(f"coalesce({x}, 0)") for x in ("fp_with", "scr_with", "d_fp_va", "d_scr_va", "d_fp_tr", "d_scr_tr"))
_N, _D, _N1, _D1 = f"({_FP} + {_DFT} + {_DFV})", f"({_SCR} + {_DST} + {_DSV})", f"({_FP} + {_DFT})", f"({_SCR} + {_DST})"
_GAP = lambda n, d, n0, d0: _r(f"({n} * {d0} - {n0} * {d})", f"({d} * {d0})", 100, 1)
_TOLD, _NO, _TAB = "has AND published_ratio IS NOT NULL", "has AND published_ratio IS NULL AND fp_with IS NULL", "has AND published_ratio IS NULL AND fp_with IS NOT NULL"
_W = lambda name: f"CASE WHEN company_id % 23 = 0 AND '{name}' IN ('mcr', 'best_estimate') THEN 'Read from a summary: {name}' END"
_V, _A, _PG = "company_id % 3 = 0", "agrees", "source_page"


def _rows() -> list[tuple]:
    """(name, condition, value, type, factor, remark, components (label, value, unit, operation, kpi, page, valid, warning, condition))."""
    kpi = lambda name, label, op, value=None: (label, value or name, "pct" if name == "ratio_scr" else "MEUR", op, f"'{name}'", "company_id % 40 + 1", _V, _W(name), "true")
    pct = lambda label, value, op, page, valid, code="NULL", warning="NULL": (label, value, "pct", op, code, page, valid, warning, "true")
    eff = lambda label, x, op, when: (label, x, "MEUR", op, "NULL", _PG, _A, "NULL", when)
    without, impact = "ratio_scr_without_lt", "impact_va"
    remark = f"CASE WHEN transitional THEN '{official.STEPS}' ELSE '{official.ADJUSTMENT}' END"
    return [
        (without, _TOLD, _r(_u("published_ratio"), _ONE, 1, 1), "difference", 1, "NULL", [pct("Published ratio without adjustment", "published_ratio", "+", _PG, "false")]),
        (impact, f"{_TOLD} AND ratio_scr <> 0", _r(f"({_u('published_ratio')} - {_u('ratio_scr')})", _ONE, 1, 1), "difference", 1, "NULL", [pct("Ratio without measures", "published_ratio", "+", _PG, "false", f"'{without}'"), kpi("ratio_scr", "Published ratio", "-")]),
        (without, _NO, "ratio_scr", "difference", 1, f"'{official.NONE}'", [kpi("ratio_scr", "Published ratio", "+")]),
        (impact, f"{_NO} AND ratio_scr IS NOT NULL", "0.0", "difference", 1, f"'{official.NONE}'", [pct("Ratio without measures", "ratio_scr", "+", "company_id % 40 + 1", _V, f"'{without}'"), kpi("ratio_scr", "Published ratio", "-")]),
        (without, f"{_TAB} AND own_funds IS NOT NULL AND scr_total IS NOT NULL", _r(_N, _D, 100, 1), "ratio", 100, remark, [kpi("own_funds", "Own funds", "num", "fp_with"), eff("Transitional measure, own funds", "d_fp_tr", "num", "transitional"), eff("Adjustment, own funds", "d_fp_va", "num", "true"), kpi("scr_total", "Requirement", "den", "scr_with"), eff("Transitional measure, requirement", "d_scr_tr", "den", "transitional"), eff("Adjustment, requirement", "d_scr_va", "den", "true")]),
        (impact, f"{_TAB} AND own_funds IS NOT NULL AND scr_total IS NOT NULL", _GAP(_N, _D, _N1, _D1), "difference", 1, remark, [pct("Ratio without measures", _r(_N, _D, 100, 4), "+", _PG, f"{_V} AND {_A}", f"'{without}'"), pct("Ratio before the adjustment goes", _r(_N1, _D1, 100, 4), "-", _PG, _A)]),
        ("impact_transitional", f"{_TAB} AND own_funds IS NOT NULL AND scr_total IS NOT NULL AND transitional", _GAP(_N1, _D1, _FP, _SCR), "difference", 1, "NULL", [pct("Ratio without transitional measure", _r(_N1, _D1, 100, 4), "+", _PG, _A), pct("Ratio with measures", _r(_FP, _SCR, 100, 4), "-", _PG, _A)]),
        ("margin_on_estimate", "true", _r(_u("risk_margin"), _u("best_estimate"), 100, 2), "ratio", 100, "NULL", [kpi("risk_margin", "Risk margin", "num"), kpi("best_estimate", "Best estimate", "den")]),
        ("mcr_pct_of_scr", "perimeter = 'solo' AND mcr <> 0 AND scr_total <> 0", _r(_u("mcr"), _u("scr_total"), 100, 2), "ratio", 100, "NULL", [kpi("mcr", "MCR", "num"), kpi("scr_total", "SCR", "den")]),
    ]


def _sql() -> str:
    cents = lambda x: f"floor(({x}) * 100) / 100"
    on = lambda cond, x: f"CASE WHEN {cond} THEN {x} END"
    tab, steps = "company_id % 8 BETWEEN 3 AND 6", "company_id % 8 = 6"
    meas = f"""meas AS (SELECT company_id, year, true AS has, {on('company_id % 8 = 0', cents('ratio_scr - company_id % 30'))} AS published_ratio, {on(tab, cents('own_funds') + ' + CASE WHEN company_id % 10 = 3 THEN 0.02::DOUBLE ELSE 0 END')} AS fp_with, {on(tab, cents('scr_total'))} AS scr_with,
  {on(tab, '-' + cents('tier2 / 10'))} AS d_fp_va, {on(tab, cents('scr_total / 50'))} AS d_scr_va, {on(steps, '-' + cents('tier3 / 20'))} AS d_fp_tr, {on(steps, cents('scr_total / 80'))} AS d_scr_tr, {steps} AS transitional, company_id % 30 + 2 AS source_page FROM p WHERE company_id % 8 < 7),
base AS (SELECT p.*, perimeter, meas.* EXCLUDE (company_id, year, has), coalesce(has, false) AS has, coalesce(abs({_u('fp_with')} - {_u('own_funds')}) <= 1000000 AND abs({_u('scr_with')} - {_u('scr_total')}) <= 1000000, false) AS agrees FROM p LEFT JOIN companies USING (company_id) LEFT JOIN meas USING (company_id, year))"""
    values, comps = [], []
    for name, cond, value, kind, factor, remark, parts in _rows():
        values.append(f"SELECT company_id, year, '{name}' AS kpi_name, {value} AS value, '{kind}' AS type, {factor} AS factor, {remark} AS remark FROM base WHERE ({cond}) AND ({value}) IS NOT NULL")
        for at, (label, x, unit, op, code, page, valid, warning, when) in enumerate(parts):
            comps.append(f"SELECT company_id, year, '{name}' AS kpi_name, {at} AS spot, '{label}' AS label, {x} AS value, '{unit}' AS unit, '{op}' AS operation, {code} AS kpi_code, ({page})::INT AS page, {valid} AS valid, {warning} AS warning FROM base WHERE ({cond}) AND ({value}) IS NOT NULL AND {when}")
    loss = f"""lg AS (SELECT o_custkey AS company_id, year(o_orderdate)::INT AS year, substr(o_orderpriority, 1, 1)::INT AS idx, count(*) * 10.0::DOUBLE AS premium, {cents('sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 20000')} AS claim FROM orders GROUP BY ALL),
lines AS (SELECT *, CASE WHEN idx < 3 THEN 'line' WHEN idx = 3 THEN 'Non-life, direct' WHEN idx = 4 THEN 'Life, direct' WHEN company_id % 9 = 0 THEN 'other' ELSE 'Health, non-life' END AS label,
  CASE WHEN idx IN (1, 3) THEN 'non-life' WHEN idx IN (2, 4) THEN 'life' WHEN company_id % 9 <> 0 THEN 'non-life' END AS class FROM lg),
ls AS (SELECT company_id, year, sum({_u('premium')}) FILTER (class = 'non-life') AS prem, coalesce(sum({_u('claim')}) FILTER (class = 'non-life'), 0) AS cl, bool_or(class IS NULL) AS unclear FROM lines GROUP BY ALL),
lv AS (SELECT company_id, year, {_r('cl', 'prem', 100, 1)} AS value FROM ls JOIN base USING (company_id, year) WHERE NOT unclear AND prem >= 1000000000 AND prem * 10 >= {_u('premiums')})"""
    values.append("SELECT company_id, year, 'loss_ratio', value, 'ratio', 100, 'Non-life lines only.' FROM lv")
    for at, (op, col) in enumerate((("num", "claim"), ("den", "premium"))):
        comps.append(f"SELECT company_id, year, 'loss_ratio', {at * 10} + idx, label, {col}, 'MEUR', '{op}', NULL, idx + 10, (idx + company_id) % 4 <> 0, NULL FROM lines JOIN lv USING (company_id, year) WHERE class = 'non-life'")
    total = lambda op: f"coalesce(sum({_u('value')}) FILTER (operation = '{op}'), 0)"
    return f"""WITH {COMPANIES_SQL}, {KPIS_SQL}, {meas}, {loss}, vals AS ({' UNION ALL '.join(values)}), comps AS ({' UNION ALL '.join(comps)}),
sums AS (SELECT company_id, year, kpi_name, {total('num')} AS num, {total('den')} AS den, {total('+')} AS plus, {total('-')} AS minus, count(*) AS n_components, bool_and(valid) AS all_valid, list_distinct(list(warning) FILTER (warning IS NOT NULL)) AS notes FROM comps GROUP BY ALL),
re AS (SELECT vals.*, n_components, all_valid, notes, CASE WHEN type = 'ratio' THEN {_r('num', 'den', 100, 4)} ELSE {_r('(plus - minus)', _ONE, 1, 4)} * factor END AS recomputed FROM vals JOIN sums USING (company_id, year, kpi_name)),
fin AS (SELECT *, coalesce(abs(recomputed - value) <= 0.05 + 1e-9::DOUBLE, false) AS ok FROM re),
official AS (SELECT company_id, year, kpi_name, value, type, remark, n_components, recomputed, ok AND all_valid AS valid, len(coalesce(notes, [])) > 0 OR NOT ok AS warned, nullif(array_to_string(list_concat(list_sort(coalesce(notes, [])), CASE WHEN ok THEN [] ELSE ['{official.MISMATCH}'] END), ' '), '') AS note FROM fin)"""


SQL_BASE = _sql()


@query(f"{SQL_BASE} SELECT * FROM official")
def official_indicators(spark, d):
    return indicators(spark, d).select(*KEYS, "kpi_name", "value", "type", "remark", F.size("components").cast("long").alias("n_components"), "recomputed", "valid", "warned", "note")


@query(f"{SQL_BASE} SELECT company_id, year, kpi_name, row_number() OVER (PARTITION BY company_id, year, kpi_name ORDER BY spot) AS place, label, value, unit, operation, kpi_code, page, valid, warning FROM comps")
def official_components(spark, d):
    return official.components_of(indicators(spark, d))


@query(f"{SQL_BASE} SELECT company_id, year, kpi_name, value, validated, CASE WHEN company_id % 23 = 0 AND kpi_name IN ('mcr', 'best_estimate') THEN 'Read from a summary: ' || kpi_name END AS warning FROM kpis UNION ALL SELECT company_id, year, kpi_name, value, valid, note FROM official")
def kpis_with_computed(spark, d):
    return official.with_computed(warned_kpis(spark, d), indicators(spark, d))
