"""Controls of sections, ranges by activity, explained failures and the table of measures, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import controls, measures
from tessera.operators.indicators import wide
from tessera.plans.domain import _CHECKS, _checks
from tessera.plans.fixtures import companies, kpis
from tessera.plans.queries import CK, K, c, query
from tessera.session import table
from tessera.sources.files import written

KEYS = ["company_id", "year"]
#: What millions are multiplied by: printed in thousands, millions or units.
SCALES = [1000.0, 1.0, 1e6]


def _printed(x):
    """Whole number that stands for ``x`` cents of a thousandth, as the order's section prints it."""
    k = c("company_id") % 3
    return F.when(k == 0, F.floor((x + 50) / 100)).when(k == 1, F.floor((x + 5000) / 10000)).otherwise(x * 10)


def section_lines(spark, d) -> DataFrame:
    """An order is a company; its lines are premiums or claims, some of them zero."""
    cents = (c("l_extendedprice") * 100 + 0.5).cast("long")
    x = table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(c("l_orderkey").alias("company_id"), F.when(c("l_linenumber") % 2 == 1, "premiums").otherwise("claims").alias("section"), c("l_linenumber").alias("idx")).agg(F.max(cents).alias("cents"), F.max("l_suppkey").alias("s"))
    x = x.withColumn("cents", F.when(c("s") % 13 == 0, F.lit(0).cast("long")).otherwise(c("cents")))
    return x.withColumn("value", c("cents") / 100000.0)


def section_amounts(lines: DataFrame) -> DataFrame:
    """What a section prints: most of its lines, a share and a net figure (wrong in some); some claims are a picture."""
    at = ["company_id", "section"]
    seen = (c("company_id") % 11 != 0) | (c("section") != "claims")
    one = lines.where(seen & (c("s") % 7 != 0) & (c("cents") > 0)).select(*at, _printed(c("cents")).alias("n"))
    total = lines.where(seen).groupBy(*at).agg(F.sum("cents").alias("t"))
    share, off = _printed(F.floor(c("t") / 5)), F.when(c("company_id") % 5 == 0, _printed(F.lit(50_000_000))).otherwise(0)
    both = total.select(*at, F.explode(F.array(share, _printed(c("t")) - share + off)).alias("n"))
    tenth = c("company_id") % 3 == 1
    return one.union(both).select(*at, (c("n") / F.when(tenth, 10.0).otherwise(1.0)).alias("amount"), tenth.cast("int").alias("decimals")).distinct()


_P = lambda x: f"(CASE company_id % 3 WHEN 0 THEN ({x} + 50) // 100 WHEN 1 THEN ({x} + 5000) // 10000 ELSE ({x}) * 10 END)"
_LAST = lambda x: f"(CASE {x} WHEN 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)"
_SECTIONS = f"""l0 AS (SELECT l_orderkey AS company_id, CASE WHEN l_linenumber % 2 = 1 THEN 'premiums' ELSE 'claims' END AS section, l_linenumber AS idx, max((l_extendedprice * 100)::BIGINT) AS cents, max(l_suppkey) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
l AS MATERIALIZED (SELECT * REPLACE (CASE WHEN s % 13 = 0 THEN 0 ELSE cents END AS cents), CASE WHEN s % 13 = 0 THEN 0 ELSE cents END / 100000.0::DOUBLE AS value FROM l0),
t AS (SELECT company_id, section, sum(cents)::BIGINT AS t FROM l WHERE company_id % 11 <> 0 OR section <> 'claims' GROUP BY ALL),
n AS (SELECT company_id, section, {_P('cents')} AS n FROM l WHERE (company_id % 11 <> 0 OR section <> 'claims') AND s % 7 <> 0 AND cents > 0
  UNION ALL SELECT company_id, section, {_P('t // 5')} FROM t UNION ALL SELECT company_id, section, {_P('t')} - {_P('t // 5')} + CASE WHEN company_id % 5 = 0 THEN {_P('50000000')} ELSE 0 END FROM t),
a AS MATERIALIZED (SELECT DISTINCT company_id, section, n / CASE WHEN company_id % 3 = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS amount, (company_id % 3 = 1)::INT AS decimals FROM n),
sc AS (SELECT unnest([0, 1, 2]) AS ord, unnest([1000.0, 1.0, 1000000.0])::DOUBLE AS scale),
h AS (SELECT company_id, section, idx, ord, min(amount) AS printed FROM l JOIN a USING (company_id, section), sc WHERE value <> 0 AND abs(amount - abs(value) * scale) <= 0.5::DOUBLE * {_LAST('decimals')} + 1e-6 * greatest(abs(value) * scale, 1.0::DOUBLE) GROUP BY ALL),
b AS (SELECT company_id, section, -max([n, -ord])[2] AS ord FROM (SELECT company_id, section, ord, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL),
pr AS MATERIALIZED (SELECT l.company_id, l.section, l.idx, l.value, sc.scale, h.printed, EXISTS (SELECT 1 FROM a WHERE a.company_id = l.company_id AND a.section = l.section) AS controllable FROM l LEFT JOIN b USING (company_id, section) JOIN sc ON sc.ord = coalesce(b.ord, 0) LEFT JOIN h ON h.company_id = l.company_id AND h.section = l.section AND h.idx = l.idx AND h.ord = sc.ord),
sm AS (SELECT company_id, section, sum(value::DECIMAL(38,6))::DOUBLE * any_value(scale) AS gross, any_value(scale) AS scale, 0.5::DOUBLE * (count(*) + 2) AS tol FROM pr WHERE controllable GROUP BY ALL),
f AS MATERIALIZED (SELECT a.* FROM a WHERE amount > 0 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.company_id = a.company_id AND pr.section = a.section AND pr.printed = a.amount)),
g AS (SELECT company_id, section, min([x.amount, y.amount]) AS p FROM sm JOIN f x USING (company_id, section) JOIN f y USING (company_id, section) WHERE abs(abs(gross - x.amount) - y.amount) <= tol * {_LAST('least(x.decimals, y.decimals)')} GROUP BY ALL),
su AS (SELECT sm.*, p[1] AS share FROM sm LEFT JOIN g USING (company_id, section)),
e AS (SELECT pr.*, controllable AND (value = 0 OR printed IS NOT NULL) AND share IS NOT NULL AS passed FROM pr LEFT JOIN su USING (company_id, section)),
r0 AS (SELECT company_id, sum(value::DECIMAL(38,6)) FILTER (section = 'claims')::DOUBLE / nullif(sum(value::DECIMAL(38,6)) FILTER (section = 'premiums')::DOUBLE, 0) * 100 AS v FROM l GROUP BY 1),
r AS (SELECT *, floor(v * 10 + 0.5::DOUBLE) / 10 + CASE WHEN company_id % 17 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM r0 WHERE v IS NOT NULL)"""


@query(f"""WITH {_SECTIONS} SELECT company_id, 'line_' || section || '_' || idx AS check_name, value AS expected, CASE WHEN passed THEN value END AS computed, passed, controllable, CASE WHEN NOT controllable THEN 'no amount in the section' WHEN value = 0 THEN 'zero' WHEN printed IS NULL THEN 'not printed' ELSE 'printed' END AS reason FROM e
UNION ALL SELECT company_id, 'identity_' || section, gross / scale, (gross - share) / scale, share IS NOT NULL, true, CASE WHEN share IS NOT NULL THEN 'adds up' ELSE 'no share and net add up' END FROM su
UNION ALL SELECT company_id, 'recomputed_ratio', ratio, v, abs(v - ratio) <= 0.05::DOUBLE + 1e-9, true, CASE WHEN abs(v - ratio) <= 0.05::DOUBLE + 1e-9 THEN 'agrees' ELSE 'differs' END FROM r""")
def section_controls(spark, d):
    lines = written(section_lines(spark, d))  # read by all that follows
    part = lambda s: F.sum(F.when(c("section") == s, c("value").cast("decimal(38,6)"))).cast("double")
    v = lines.groupBy("company_id").agg((F.try_divide(part("claims"), part("premiums")) * 100).alias("v"))
    stored = v.select("company_id", (F.floor(c("v") * 10 + 0.5) / 10 + F.when(c("company_id") % 17 == 0, 3.0).otherwise(0.0)).alias("ratio"))
    single = controls.section_controls(lines, section_amounts(lines), ["company_id"], SCALES)
    return single.union(controls.ratio_control(lines, stored, ["company_id"], "claims", "premiums", 0.05))


@query(CK + """SELECT company_id, year, activity, round(best_estimate / scr_total, 8) AS ratio, low, high, best_estimate / scr_total BETWEEN low AND high AS passed FROM p JOIN companies USING (company_id)
JOIN (VALUES ('life', 2.2::DOUBLE, 150.0::DOUBLE), ('non-life', 0.1::DOUBLE, 4.0::DOUBLE), ('health', 0.02::DOUBLE, 30.0::DOUBLE)) v(activity, low, high) USING (activity) WHERE best_estimate <> 0 AND scr_total <> 0""")
def ranges_by_activity(spark, d):
    w = wide(kpis(spark, d), ["best_estimate", "scr_total"]).where("best_estimate <> 0 AND scr_total <> 0")
    j = w.join(companies(spark, d).select("company_id", "activity"), "company_id").withColumn("_q", c("best_estimate") / c("scr_total"))
    out = controls.in_range_by(j, {"life": (2.2, 150.0), "non-life": (0.1, 4.0), "health": (0.02, 30.0)}, "activity", "_q")
    return out.select("company_id", "year", "activity", F.round("_q", 8).alias("ratio"), "low", "high", "passed")


@query(f"{K}, {_CHECKS} SELECT company_id, year, check_name, passed, CASE WHEN passed THEN 'passed' WHEN company_id % 26 = 0 AND check_name = 'identity_own_funds' THEN 'explained' ELSE 'failed' END AS state, CASE WHEN NOT passed AND company_id % 26 = 0 AND check_name = 'identity_own_funds' THEN 'five millions are held elsewhere' END AS explanation FROM checks")
def explained_failures(spark, d):
    known = companies(spark, d).where("company_id % 26 = 0").select("company_id", F.lit("identity_own_funds").alias("check_name"), F.lit("five millions are held elsewhere").alias("explanation"))
    return controls.annotated(_checks(spark, d), known, ["company_id", "check_name"]).select(*KEYS, "check_name", "passed", "state", "explanation")


# --- the table of measures --------------------------------------------------------------------------------------------


def _sources(spark, d, off: float = 0.0):
    """Three sources of measures; with ``off``, some printed own funds are so far from the stored ones."""
    w = wide(kpis(spark, d), ["own_funds", "scr_total", "ratio_scr", "tier2", "tier3"])
    k, zero = c("company_id"), F.lit(0.0)
    unit = F.when(k % 3 == 0, "thousands").when(k % 3 == 1, "units").otherwise("millions")
    by = F.when(k % 3 == 0, 1e3).when(k % 3 == 1, 1e6).otherwise(1.0)
    gap = F.when(k % 10 == 3, off).otherwise(0.0) if off else zero
    tables = w.where(k % 4 != 2).where((k % 4 < 2) | (k % 4 == 3) & (k % 5 == 0)).select(*KEYS, unit.alias("unit"), ((c("own_funds") + gap) * by).alias("fp_with"), (c("scr_total") * by).alias("scr_with"), F.when(k % 5 != 0, (zero - c("tier2")) * by).alias("d_fp_va"), (c("tier2") / 10 * by).alias("d_scr_va"), F.when(k % 8 == 0, (zero - c("tier3")) * by).otherwise(zero).alias("d_fp_tr"), F.lit(None).cast("double").alias("d_scr_tr"))
    published = w.where(k % 4 == 2).select(*KEYS, (c("ratio_scr") - k % 30).alias("published_ratio"))
    return w, tables, published, w.where((k % 4 == 3) | (k % 12 == 0)).select(*KEYS)


_TABLE = lambda off: f"""bz AS (SELECT *, CASE company_id % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1.0::DOUBLE END AS k, CASE WHEN company_id % 10 = 3 THEN {off}::DOUBLE ELSE 0.0::DOUBLE END AS gap FROM p),
m AS MATERIALIZED (SELECT company_id, year, true AS uses_va, company_id % 8 = 0 AND tier3 <> 0 AS transitional, (own_funds + gap) * k / k AS fp_with, scr_total * k / k AS scr_with, CASE WHEN company_id % 5 <> 0 THEN (0.0::DOUBLE - tier2) * k / k ELSE 0.0::DOUBLE END AS d_fp_va, tier2 / 10 * k / k AS d_scr_va, CASE WHEN company_id % 8 = 0 THEN (0.0::DOUBLE - tier3) * k / k ELSE 0.0::DOUBLE END AS d_fp_tr, 0.0::DOUBLE AS d_scr_tr, NULL::DOUBLE AS published_ratio FROM bz WHERE company_id % 4 < 2 OR company_id % 4 = 3 AND company_id % 5 = 0
UNION ALL SELECT company_id, year, true, false, NULL, NULL, NULL, NULL, 0.0, 0.0, ratio_scr - company_id % 30 FROM bz WHERE company_id % 4 = 2
UNION ALL SELECT company_id, year, false, false, NULL, NULL, 0.0, 0.0, 0.0, 0.0, NULL FROM bz WHERE company_id % 4 = 3 AND company_id % 5 <> 0)"""  # noqa: E731


@query(f"{K}, {_TABLE('0.0')} SELECT * FROM m")
def measure_table(spark, d):
    """Companies that report; the whole table, or an error."""
    w, tables, published, unused = _sources(spark, d)
    return measures.whole_measure_table(w.select("company_id").distinct(), w, tables, published, unused)


@query(f"{K}, {_TABLE('0.02')} SELECT company_id, year, fp_with, own_funds, scr_with, p.scr_total FROM m JOIN p USING (company_id, year) WHERE abs(fp_with - own_funds) > 0.01 OR abs(scr_with - scr_total) > 0.01")
def measures_unlike_stored(spark, d):
    w, tables, published, unused = _sources(spark, d, 0.02)
    return measures.unlike_stored(measures.measure_table(tables, published, unused), w)


@query(CK + "SELECT company_id, name FROM companies WHERE company_id NOT IN (SELECT company_id FROM p WHERE company_id % 4 <> 3)")
def companies_without_measures(spark, d):
    """The table without those that use none."""
    _, tables, published, unused = _sources(spark, d)
    made = measures.measure_table(tables.where("company_id % 4 <> 3"), published, unused.where("company_id % 4 = 0"))
    return measures.without_measure_row(companies(spark, d).select("company_id", "name"), made)
