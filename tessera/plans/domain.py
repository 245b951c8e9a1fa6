"""Queries of indicators, checks, comparability, extraction, documents and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import comparability as cmp
from tessera.operators import documents, indicators, ordering, places
from tessera.plans.fixtures import NAMES, companies, kpis
from tessera.plans.queries import CK, C, K, c, query
from tessera.session import table
from tessera.streaming import events as ev

# --- indicators ---------------------------------------------------------------------------------------------------------


@query(K + "SELECT company_id, year, round(tier1 / nullif(own_funds, 0) * 100, 1) AS tier1_share, round(risk_margin / nullif(best_estimate, 0) * 100, 2) AS margin_on_estimate, round(scr_total / nullif(premiums + best_estimate, 0) * 100, 2) AS capital_intensity FROM p")
def indicators_ratios(spark, d):
    return indicators.ratios(kpis(spark, d))


_TIERS = ["tier1", "tier1_restricted", "tier2", "tier3"]


@query(K + "SELECT k.company_id, k.year, kpi_name AS module, round(value / (s::DOUBLE) * 100, 1) + 0.0 AS share FROM kpis k JOIN (SELECT company_id, year, sum(value::DECIMAL(38,6)) AS s FROM kpis WHERE kpi_name LIKE 'tier%' AND company_id % 4 <> 0 GROUP BY ALL HAVING sum(value) > 0) t USING (company_id, year) WHERE kpi_name LIKE 'tier%' AND value IS NOT NULL")
def module_composition(spark, d):
    # shares of an internal model's own categories would mislead beside the standard formula's
    return indicators.composition(kpis(spark, d).where("company_id % 4 <> 0"), _TIERS)


@query("""WITH x AS (SELECT l_suppkey AS company_id, year(l_shipdate)::INT AS year, l_linenumber, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'R' THEN 'V' ELSE CASE WHEN l_orderkey % 50 <> 0 THEN 'N' END END AS class, l_extendedprice::DECIMAL(18,2) AS premium, l_tax::DECIMAL(18,2) * 1000 AS claim FROM lineitem),
g AS (SELECT company_id, year, sum(premium) FILTER (class = 'N')::DOUBLE AS p, sum(claim) FILTER (class = 'N')::DOUBLE AS cl, sum(premium)::DOUBLE AS t, bool_or(class IS NULL) AS u FROM x GROUP BY ALL)
SELECT company_id, year, CASE WHEN NOT u AND p >= 10000 AND p >= 0.1 * t THEN round(cl / p * 100, 1) END AS loss_ratio FROM g""")
def loss_ratio_guarded(spark, d):
    li = table(spark, d, "lineitem")
    cls = F.when(c("l_returnflag") == "A", "N").when(c("l_returnflag") == "R", "V").when(c("l_orderkey") % 50 != 0, "N")
    x = li.select(c("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("year"), cls.alias("class"), c("l_extendedprice").cast("decimal(18,2)").alias("premium"), (c("l_tax").cast("decimal(18,2)") * 1000).alias("claim"))
    return indicators.guarded_loss_ratio(x, 10000.0, 0.1)


@query(CK + "SELECT company_id, year, round(mcr / nullif(scr_total, 0) * 100, 2) AS mcr_pct, CASE WHEN mcr / nullif(scr_total, 0) IS NULL THEN NULL WHEN abs(mcr / scr_total * 100 - 25) < 0.6 THEN 'floor' WHEN abs(mcr / scr_total * 100 - 45) < 0.6 THEN 'cap' WHEN mcr / scr_total * 100 > 45.6 THEN 'absolute floor' ELSE 'between' END AS position FROM p WHERE company_id IN (SELECT company_id FROM companies WHERE perimeter = 'solo')")
def mcr_position(spark, d):
    return indicators.minimum_position(kpis(spark, d), companies(spark, d).where("perimeter = 'solo'"))


_MEASURES = """x AS (SELECT company_id, year, ratio_scr, company_id % 3 <> 0 AS used, company_id % 2 = 0 AS tr, CASE WHEN company_id % 5 = 0 THEN ratio_scr - 12.5 END AS pub, own_funds / nullif(scr_total, 0) * 100 AS f,
 (own_funds + coalesce(CASE WHEN company_id % 2 = 0 THEN -tier2 END, 0)) / nullif(scr_total, 0) * 100 AS a, (own_funds + coalesce(CASE WHEN company_id % 2 = 0 THEN -tier2 END, 0) + coalesce(-tier3, 0)) / nullif(scr_total + coalesce(mcr, 0), 0) * 100 AS b FROM p),
lt AS (SELECT company_id, year, CASE WHEN pub IS NOT NULL THEN round(pub, 1) WHEN NOT used THEN ratio_scr ELSE round(b, 1) + 0.0 END AS ratio_without, CASE WHEN pub IS NOT NULL THEN round(pub - ratio_scr, 1) WHEN NOT used THEN 0.0 ELSE round(b - a, 1) + 0.0 END AS impact_va,
 CASE WHEN pub IS NULL AND used AND tr THEN round(a - f, 1) + 0.0 END AS impact_tr, CASE WHEN pub IS NOT NULL THEN round(pub - ratio_scr, 1) WHEN NOT used THEN 0.0 ELSE round(b - f, 1) + 0.0 END AS impact_all, CASE WHEN pub IS NOT NULL THEN 'published' WHEN NOT used THEN 'none' ELSE 'stepwise' END AS basis FROM x)"""


def _measures(spark, d, carry: tuple[str, ...] = ()) -> DataFrame:
    w = indicators.wide(kpis(spark, d), ["own_funds", "scr_total", "tier2", "tier3", "mcr", "ratio_scr"])
    i, used = c("company_id"), c("company_id") % 3 != 0
    m = w.select("company_id", "year", used.alias("uses_va"), (used & (i % 2 == 0)).alias("transitional"), c("own_funds").alias("fp_with"), c("scr_total").alias("scr_with"), (-c("tier3")).alias("d_fp_va"), c("mcr").alias("d_scr_va"), F.when(i % 2 == 0, -c("tier2")).alias("d_fp_tr"), F.lit(None).cast("double").alias("d_scr_tr"), F.when(i % 5 == 0, c("ratio_scr") - 12.5).alias("published_without"), c("ratio_scr").alias("ratio_stored"), *carry)
    return indicators.without_measures(m, carry)


@query(f"{K}, {_MEASURES} SELECT * FROM lt")
def lt_step_impact(spark, d):
    return _measures(spark, d)


@query(K + """SELECT company_id, year, n AS kpi_name, round(v, 4) AS recomputed, s AS value, abs(round(v, 4) - s) <= 0.05 AS ok, abs(round(v, 4) - s) <= 0.05 AND company_id % 3 = 0 AS valid FROM (
 SELECT company_id, year, 'ratio_scr' AS n, own_funds / nullif(scr_total, 0) * 100 AS v, ratio_scr AS s FROM p UNION ALL SELECT company_id, year, 'technical_provisions', best_estimate + risk_margin, technical_provisions FROM p)""")
def component_recompute(spark, d):
    k = kpis(spark, d)
    parts = {"own_funds": ("ratio_scr", "num"), "scr_total": ("ratio_scr", "den"), "best_estimate": ("technical_provisions", "+"), "risk_margin": ("technical_provisions", "+")}
    kpi = F.create_map(*[F.lit(x) for n, (t, _) in parts.items() for x in (n, t)])
    op = F.create_map(*[F.lit(x) for n, (_, o) in parts.items() for x in (n, o)])
    comp = k.where(c("kpi_name").isin(*parts)).select("company_id", "year", kpi[c("kpi_name")].alias("kpi_name"), op[c("kpi_name")].alias("operation"), c("value").alias("component_value"), c("validated").alias("valid"))
    forms = comp.select("company_id", "year", "kpi_name").distinct().select("*", F.when(c("kpi_name") == "ratio_scr", "ratio").otherwise("difference").alias("type"), F.when(c("kpi_name") == "ratio_scr", 100.0).otherwise(1.0).alias("factor"))
    return indicators.recomputed(comp, forms, k.select("company_id", "year", "kpi_name", "value"), 0.05)


_LIMITS = {"ceilings": {"own_funds": 1000.0, "best_estimate": 2000.0}, "floors": {"scr_total": 50.0}, "signs": {"own_funds": 1, "risk_margin": 1}}


def _checks(spark, d) -> DataFrame:
    return indicators.checks(kpis(spark, d), beta=(1.0, 3.0), **_LIMITS)


_CHECKS = """x AS (SELECT company_id, year, 'identity_provisions' AS check_name, technical_provisions AS expected, round(best_estimate + risk_margin, 8) AS computed, abs(technical_provisions - (best_estimate + risk_margin)) <= 0.5 AS passed FROM p
UNION ALL SELECT company_id, year, 'identity_own_funds', own_funds, round(tier1 + tier1_restricted + tier2 + tier3, 8), abs(own_funds - (tier1 + tier1_restricted + tier2 + tier3)) <= 0.5 FROM p
UNION ALL SELECT company_id, year, 'ratio_scr', ratio_scr, round(own_funds / nullif(scr_total, 0) * 100, 8), abs(ratio_scr - own_funds / nullif(scr_total, 0) * 100) <= 1 FROM p
UNION ALL SELECT company_id, year, 'mcr_below_scr', scr_total, round(mcr, 8), mcr < scr_total FROM p
UNION ALL SELECT company_id, year, 'plausible_estimate', 3.0, round(best_estimate / nullif(scr_total, 0), 8), best_estimate / nullif(scr_total, 0) BETWEEN 1 AND 3 FROM p
UNION ALL SELECT company_id, year, 'sign_' || kpi_name, 0.0, value, value >= 0 FROM kpis WHERE kpi_name IN ('own_funds', 'risk_margin')
UNION ALL SELECT company_id, year, 'ceiling_' || kpi_name, CASE kpi_name WHEN 'own_funds' THEN 1000.0 ELSE 2000.0 END, value, abs(value) <= CASE kpi_name WHEN 'own_funds' THEN 1000.0 ELSE 2000.0 END FROM kpis WHERE kpi_name IN ('own_funds', 'best_estimate')
UNION ALL SELECT company_id, year, 'floor_scr_total', 50.0, value, value >= 50 FROM kpis WHERE kpi_name = 'scr_total'),
checks AS (SELECT * FROM x WHERE passed IS NOT NULL AND computed IS NOT NULL)"""


@query(f"{K}, {_CHECKS} SELECT company_id, year, check_name, expected::DOUBLE AS expected, computed, passed FROM checks")
def checks_all(spark, d):
    return _checks(spark, d)


@query(f"{K}, {_CHECKS} SELECT company_id, year, count(*) AS n, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed), '') AS failures FROM checks GROUP BY ALL")
def validation_summary(spark, d):
    bad = F.array_join(F.sort_array(F.collect_list(F.when(~c("passed"), c("check_name")))), ",")
    return _checks(spark, d).groupBy("company_id", "year").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(~c("passed")).alias("failed"), bad.alias("failures"))


_FLAGGED = ["own_funds", "mcr", "scr_total", "ratio_scr"]


@query(f"{K}, {_CHECKS}, f AS (SELECT company_id, year, n AS kpi_name, bool_and(passed) AS ok FROM checks, (SELECT unnest(['own_funds','mcr','scr_total','ratio_scr']) AS n) WHERE contains(check_name, n) GROUP BY ALL) SELECT company_id, year, kpi_name, coalesce(ok, validated) AS validated FROM kpis LEFT JOIN f USING (company_id, year, kpi_name)")
def validated_flag(spark, d):
    return indicators.validated_flags(kpis(spark, d), _checks(spark, d), _FLAGGED).select("company_id", "year", "kpi_name", "validated")


@query(f"{K}, {_CHECKS} SELECT CASE WHEN check_name LIKE 'sign_%' AND computed = 0 THEN 'zero sign' WHEN check_name = 'plausible_estimate' THEN 'not controllable' WHEN company_id % 13 = 0 THEN 'legitimate' ELSE 'real' END AS bucket, count(*) AS n FROM checks WHERE NOT passed GROUP BY 1")
def checks_bucket(spark, d):
    b = F.when(c("check_name").startswith("sign_") & (c("computed") == 0), "zero sign").when(c("check_name") == "plausible_estimate", "not controllable").when(c("company_id") % 13 == 0, "legitimate").otherwise("real")
    return _checks(spark, d).where(~c("passed")).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(K + "SELECT company_id, year, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, coalesce(string_agg(kpi_name, ',' ORDER BY kpi_name) FILTER (value IS NULL), '') AS missing, count(*) = 13 AND count(value) = 13 AS passed FROM kpis GROUP BY ALL")
def check_completeness(spark, d):
    return indicators.completeness(kpis(spark, d), NAMES)


# --- comparability ------------------------------------------------------------------------------------------------------


@query(C + "SELECT concat_ws(' · ', activity, model, perimeter) AS peer_group, count(*) AS n, string_agg(name, ',' ORDER BY name) AS members, count(*) < 5 AS small_sample FROM companies GROUP BY 1")
def peer_groups(spark, d):
    return cmp.peer_groups(companies(spark, d))


_PEERS = "v AS (SELECT concat_ws(' · ', activity, model, perimeter) AS peer_group, c.company_id, value FROM companies c LEFT JOIN kpis k ON k.company_id = c.company_id AND year = 1998 AND kpi_name = 'ratio_scr')"


def _peers(spark, d) -> DataFrame:
    k = kpis(spark, d).where("year = 1998 AND kpi_name = 'ratio_scr'").select("company_id", "value")
    return companies(spark, d).join(k, "company_id", "left").select(cmp.group_key().alias("peer_group"), "company_id", "value")


def _peer_sql(order: str, percentile: bool = True) -> str:
    p = "floor((k - r)::DOUBLE / nullif(k - 1, 0) * 100 + 0.5)" if percentile else "NULL::DOUBLE"
    return f"""{CK}, {_PEERS}, r AS (SELECT *, count(*) OVER (PARTITION BY peer_group) AS n, count(value) OVER (PARTITION BY peer_group) AS k, rank() OVER (PARTITION BY peer_group ORDER BY {order} NULLS LAST) AS r FROM v)
SELECT peer_group, company_id, value, CASE WHEN reason IS NULL THEN r END::INT AS rank, CASE WHEN reason IS NULL THEN {p} END AS percentile, reason FROM (SELECT *, CASE WHEN n < 5 THEN 'group too small' WHEN value IS NULL THEN 'no value' WHEN k < 5 THEN 'too few values' END AS reason FROM r)"""


@query(_peer_sql("-value"))
def peer_rank(spark, d):
    return cmp.peer_rank(_peers(spark, d), "higher")


@query(_peer_sql("abs(value)"))
def peer_rank_zero_sense(spark, d):
    return cmp.peer_rank(_peers(spark, d), "zero")


@query(f"{CK}, {_PEERS}, r AS (SELECT peer_group, company_id, value, rank() OVER (PARTITION BY peer_group ORDER BY value DESC)::INT AS rank, count(*) OVER (PARTITION BY peer_group) AS n FROM v WHERE value IS NOT NULL) SELECT peer_group, company_id, value, rank, rank = 1 AS best, rank = n AND n > 1 AS worst FROM r")
def comparative_rank(spark, d):
    return cmp.comparative_rank(_peers(spark, d), ["peer_group"])


@query(f"{CK}, {_PEERS}, r AS (SELECT *, row_number() OVER (PARTITION BY peer_group ORDER BY value DESC, company_id)::INT AS place, count(*) OVER (PARTITION BY peer_group) AS n FROM v WHERE value IS NOT NULL), m AS (SELECT peer_group, median(value) AS median FROM r GROUP BY 1) SELECT peer_group, company_id, value, place, n, median, CASE WHEN n = 1 THEN 100.0 ELSE floor((n - place)::DOUBLE / (n - 1) * 100 + 0.5) END AS percentile FROM r JOIN m USING (peer_group)")
def standing(spark, d):
    return cmp.standing(_peers(spark, d), ["peer_group"], "company_id")


@query(C + """, v AS (SELECT concat_ws(' · ', activity, model, perimeter) AS g, company_id, c_acctbal AS size FROM companies JOIN customer ON company_id = c_custkey),
r AS (SELECT a.company_id AS ref, b.company_id, row_number() OVER (PARTITION BY a.company_id ORDER BY abs(a.size - b.size), b.company_id)::INT AS place, round(abs(a.size - b.size), 4) AS gap FROM v a JOIN v b ON a.g = b.g AND a.company_id <> b.company_id WHERE a.company_id % 10 = 0) SELECT * FROM r WHERE place <= 3""")
def closest_peers(spark, d):
    rows = companies(spark, d).join(table(spark, d, "customer").select(c("c_custkey").alias("company_id"), c("c_acctbal").alias("size")), "company_id").select(cmp.group_key().alias("peer_group"), "company_id", "size")
    return cmp.closest_in_size(rows, rows.where("company_id % 10 = 0"), 3)


_MATRIX = [("ratio_scr", "activity", "C"), ("ratio_scr", "model", "R"), ("ratio_scr", "perimeter", "R"), ("claims", "activity", "N"), ("claims", "model", "C"), ("claims", "perimeter", "NA"), ("own_funds", "activity", "C"), ("own_funds", "model", "C"), ("own_funds", "perimeter", "R")]


@query(C + ", m(kpi_name, axis, verdict) AS (VALUES " + ", ".join(map(str, _MATRIX)) + """), s AS (SELECT company_id % 400 AS selection, * EXCLUDE (selection) FROM companies),
x AS (SELECT selection, 'activity' AS axis FROM s GROUP BY 1 HAVING count(DISTINCT activity) > 1 UNION ALL SELECT selection, 'model' FROM s GROUP BY 1 HAVING count(DISTINCT model) > 1 UNION ALL SELECT selection, 'perimeter' FROM s GROUP BY 1 HAVING count(DISTINCT perimeter) > 1),
w AS (SELECT selection, kpi_name, max(CASE verdict WHEN 'C' THEN 0 WHEN 'NA' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS v, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (verdict <> 'C'), '') AS axes FROM x JOIN m USING (axis) GROUP BY ALL)
SELECT selection, kpi_name, ['C','NA','R','N'][coalesce(v, 0) + 1] AS verdict, coalesce(axes, '') AS axes FROM (SELECT DISTINCT selection FROM s) CROSS JOIN (SELECT DISTINCT kpi_name FROM m) LEFT JOIN w USING (selection, kpi_name)""")
def compat_verdict(spark, d):
    m = spark.createDataFrame(_MATRIX, "kpi_name string, axis string, verdict string")
    s = companies(spark, d).withColumn("selection", c("company_id") % 400)
    return cmp.compatibility(s, m, ["activity", "model", "perimeter"])


@query(C + "SELECT selection, CASE WHEN count(*) FILTER (perimeter = 'group') > count(*) FILTER (perimeter = 'solo') THEN 'group' ELSE 'solo' END AS majority FROM companies GROUP BY 1")
def majority_perimeter(spark, d):
    return cmp.majority_perimeter(companies(spark, d))


_PANEL = """s AS (SELECT c.* EXCLUDE (selection), c.company_id // 10 AS selection, value FROM companies c LEFT JOIN kpis k ON k.company_id = c.company_id AND year = 1998 AND kpi_name = 'own_funds'), k2 AS (SELECT * FROM s WHERE NOT warned AND value IS NOT NULL),
e AS (SELECT * FROM k2 a WHERE NOT EXISTS (SELECT 1 FROM k2 b WHERE b.selection = a.selection AND b.company_id = a.parent_id))"""


def _panel(spark, d) -> DataFrame:
    k = kpis(spark, d).where("year = 1998 AND kpi_name = 'own_funds'").select("company_id", "value")
    return companies(spark, d).withColumn("selection", F.floor(c("company_id") / 10)).join(k, "company_id", "left")


@query(f"{CK}, {_PANEL}, j AS (SELECT selection, CASE WHEN count(*) FILTER (perimeter = 'group') > count(*) FILTER (perimeter = 'solo') THEN 'group' ELSE 'solo' END AS m FROM s GROUP BY 1) SELECT selection, count(*) AS n, round(avg(value::DECIMAL(20,8)), 4)::DOUBLE AS mean, median(value) AS median FROM e JOIN j USING (selection) WHERE perimeter = m GROUP BY 1")
def panel_mean_median(spark, d):
    return cmp.panel(_panel(spark, d))


@query(f"{CK}, {_PANEL} SELECT selection, company_id FROM e")
def double_count_filter(spark, d):
    return cmp.without_double_counts(_panel(spark, d).where(~c("warned") & c("value").isNotNull())).select("selection", "company_id")


ALERTS_SQL = """SELECT company_id, year, 'below_requirement' AS rule, 1 AS level FROM p WHERE ratio_scr < 100 UNION ALL SELECT company_id, year, 'near_requirement', 2 FROM p WHERE ratio_scr >= 100 AND ratio_scr < 130 UNION ALL SELECT company_id, year, 'low_quality_capital', 2 FROM p WHERE (tier2 + tier3) / nullif(scr_total, 0) * 100 >= 49.5
UNION ALL SELECT company_id, year, 'minimum_above_requirement', 1 FROM p WHERE mcr >= scr_total UNION ALL SELECT company_id, year, 'absolute_floor', 3 FROM p WHERE mcr / nullif(scr_total, 0) * 100 > 45.6
UNION ALL SELECT company_id, year, 'below_without_measures', 1 FROM lt JOIN p USING (company_id, year) WHERE ratio_without < 100 AND ratio_scr >= 100 UNION ALL SELECT company_id, year, 'large_impact', 2 FROM lt WHERE impact_all <= -50 UNION ALL SELECT company_id, year, 'transitional_measure', 3 FROM lt WHERE impact_tr IS NOT NULL"""


@query(f"{K}, {_MEASURES} {ALERTS_SQL}")
def alerts(spark, d):
    """All rules from one row a company and year."""
    return cmp.alerts(_measures(spark, d, ("ratio_scr", "tier2", "tier3", "scr_total", "mcr")))


@query(K + "SELECT company_id, year, CASE WHEN ratio_scr < 100 THEN 'danger' WHEN ratio_scr < 200 THEN 'warning' WHEN ratio_scr IS NOT NULL THEN 'good' END AS light FROM p")
def traffic_light(spark, d):
    return indicators.wide(kpis(spark, d), ["ratio_scr"]).select("company_id", "year", cmp.light(c("ratio_scr")).alias("light"))


@query(f"""{CK}, v AS (SELECT p.company_id, parent_id, premiums FROM p JOIN companies USING (company_id) WHERE year = 1998), k AS (SELECT * FROM v WHERE premiums > 0 AND (parent_id IS NULL OR parent_id NOT IN (SELECT company_id FROM v)))
SELECT company_id, premiums, round(premiums / (SELECT sum(premiums::DECIMAL(38,8))::DOUBLE FROM k) * 100, 4) AS share FROM k""")
def treemap_share(spark, d):
    """Shares of one year, which is a parameter of the chart."""
    w = indicators.wide(kpis(spark, d).where("year = 1998"), ["premiums"])
    return cmp.area_shares(w.join(companies(spark, d).select("company_id", "parent_id"), "company_id"), "premiums")


# --- extraction ---------------------------------------------------------------------------------------------------------

_CELLS = "x AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 99, sum(l_quantity) FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)"


@query(f"WITH {_CELLS}, g AS (SELECT l_orderkey, sum(v) AS s, count(v) AS n, list(v) AS l FROM x GROUP BY 1), t AS (SELECT *, list_filter(l, lambda y: abs(y - (s - y)) <= 1 AND y <> 0) AS c FROM g) SELECT l_orderkey, round(CASE WHEN len(c) = 1 AND n > 1 THEN s - c[1] ELSE s END, 4) AS total, len(c) = 1 AS excluded FROM t")
def total_column_excluded_sum(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", c("l_quantity").alias("value"))
    totals = li.where("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.sum("value").alias("value"))
    return indicators.total_excluded_sum(li.unionByName(totals), ["l_orderkey"], 1.0)


@query("""WITH e AS (SELECT DISTINCT l_orderkey, unnest([1, 2]) AS code FROM lineitem), x AS (SELECT l_orderkey, l_linenumber AS code, any_value(CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN 'wrong' ELSE 'row ' || l_linenumber END) AS label, any_value(CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber * 10.0 END) AS value FROM lineitem GROUP BY ALL),
j AS (SELECT l_orderkey, bool_and(coalesce(label = 'row ' || code, false)) AS r, count(*) FILTER (value IS NULL) AS z, sum(coalesce(value, 0))::DOUBLE AS t FROM e LEFT JOIN x USING (l_orderkey, code) GROUP BY 1)
SELECT l_orderkey, CASE WHEN r AND z = 0 THEN t END AS strict, CASE WHEN r THEN t END AS tolerant FROM j""")
def tolerant_sum(spark, d):
    li = table(spark, d, "lineitem")
    cells = li.select("l_orderkey", c("l_linenumber").alias("code")).distinct()
    cells = cells.select("l_orderkey", "code", F.when((c("l_orderkey") % 7 == 0) & (c("code") == 2), "wrong").otherwise(F.concat(F.lit("row "), c("code").cast("string"))).alias("label"), F.when(c("l_orderkey") % 5 != 0, c("code") * 10.0).alias("value"))
    expected = li.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("code")).withColumn("expected_label", F.concat(F.lit("row "), c("code").cast("string")))
    return indicators.guarded_sums(expected, cells, ["l_orderkey"], "code")


@query("""WITH h AS (SELECT l_orderkey, pr AS priority, code, min(l_quantity) AS value FROM lineitem, (VALUES (1, 5), (2, 3), (3, 1)) v(pr, code) WHERE l_linenumber = code AND l_returnflag <> 'R' GROUP BY ALL)
SELECT l_orderkey, arg_min(priority, priority) AS priority, arg_min(code, priority) AS code, arg_min(value, priority) AS value, count(*) AS successes FROM h GROUP BY 1""")
def variant_priority(spark, d):
    li = table(spark, d, "lineitem")
    cells = li.groupBy("l_orderkey", c("l_linenumber").alias("code"), F.when(c("l_returnflag") != "R", "right").otherwise("wrong").alias("label")).agg(F.min("l_quantity").alias("value"))
    variants = li.select("l_orderkey").distinct().crossJoin(F.broadcast(spark.createDataFrame([(1, 5, "right"), (2, 3, "right"), (3, 1, "right")], "priority int, code int, expected_label string")))
    return indicators.first_success(variants, cells, ["l_orderkey"])


_SRC = "s AS (SELECT p_partkey, 1 AS o, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, 2, p_retailprice * CASE WHEN p_size % 2 = 0 THEN 1.005 ELSE 1.5 END FROM part UNION ALL SELECT p_partkey, 3, p_retailprice * CASE WHEN p_size % 3 = 0 THEN 1.002 ELSE 2 END FROM part WHERE p_partkey % 5 <> 0)"


@query(f"WITH {_SRC}, g AS (SELECT a.p_partkey, a.o AS i, b.o AS j, a.v, round(abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1) * 100, 6) AS gap FROM s a JOIN s b ON a.p_partkey = b.p_partkey AND a.o < b.o) SELECT p_partkey, arg_min(v, (gap, i, j)) FILTER (gap <= 1) AS value, CASE WHEN count(*) FILTER (gap <= 1) >= 3 THEN 'high' WHEN count(*) FILTER (gap <= 1) >= 1 THEN 'partial' END AS confidence FROM g GROUP BY 1")
def consensus_2of3(spark, d):
    p = table(spark, d, "part")
    a = p.select("p_partkey", F.lit(1).alias("ordinal"), c("p_retailprice").alias("value"))
    b = p.select("p_partkey", F.lit(2), c("p_retailprice") * F.when(c("p_size") % 2 == 0, 1.005).otherwise(1.5))
    e = p.where("p_partkey % 5 <> 0").select("p_partkey", F.lit(3), c("p_retailprice") * F.when(c("p_size") % 3 == 0, 1.002).otherwise(2.0))
    return indicators.consensus(a.union(b).union(e), ["p_partkey"], 1.0)


# --- joins by place and order -------------------------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) t(i)), b AS (SELECT * FROM l WHERE trim(line) <> '')"


def _headed(spark, d) -> DataFrame:
    """Lines; a short line counts as a header."""
    return documents.lines(table(spark, d, "documents")).withColumn("header", F.when(F.length("line") < 40, c("line_no")))


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, (max(CASE WHEN length(line) < 40 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS last_header FROM b")
def asof_header(spark, d):
    return ordering.last_before(_headed(spark, d), ["doc_id"], "line_no", c("header"), "last_header").select("doc_id", "line_no", "last_header")


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, (max(CASE WHEN length(line) < 40 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::INT AS section FROM b")
def forward_fill_section(spark, d):
    return ordering.last_before(_headed(spark, d), ["doc_id"], "line_no", c("header"), "section", inclusive=True).select("doc_id", "line_no", "section")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey AS k, (s_suppkey % 50) AS lo, (s_suppkey % 50) + 7 AS hi FROM supplier) SELECT c_custkey, s_suppkey FROM customer JOIN r ON c_nationkey = k AND c_custkey % 60 BETWEEN lo AND hi""")
def range_join_bounds(spark, d):
    points = table(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("k"), (c("c_custkey") % 60).alias("x"))
    ranges = table(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("k"), (c("s_suppkey") % 50).alias("lo"), (c("s_suppkey") % 50 + 7).alias("hi"))
    return places.range_join(points, ranges, ["k"], "x", "lo", "hi", 10).select("c_custkey", "s_suppkey")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY round(abs(l_quantity - n * 10), 6), n) AS k, round(abs(l_quantity - n * 10), 6) AS gap FROM lineitem, range(1, 6) t(n)) SELECT l_orderkey, l_linenumber, l_partkey, n AS col_no, gap FROM r WHERE k = 1""")
def nearest_column(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c("l_quantity").alias("x"), F.lit(1).alias("page"))
    cols = spark.range(1, 6).select(c("id").alias("col_no"), (c("id") * 10.0).alias("tx"), F.lit(1).alias("page"))
    return places.nearest(li, F.broadcast(cols), ["page"], "x", "tx", ["l_orderkey", "l_linenumber", "l_partkey"], "col_no").select("l_orderkey", "l_linenumber", "l_partkey", "col_no", "gap")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber AS code, l_quantity AS y FROM lineitem WHERE l_linenumber < 3), b AS (SELECT DISTINCT l_orderkey, l_linenumber AS num, l_quantity AS vy FROM lineitem WHERE l_linenumber >= 3),
s AS (SELECT l_orderkey, code, y, num, vy, 'strict' AS band FROM a JOIN b USING (l_orderkey) WHERE abs(y - vy) <= 1.5), w AS (SELECT l_orderkey, code, y, num, vy, 'loose' AS band FROM a JOIN b USING (l_orderkey) WHERE y - vy BETWEEN 0 AND 8 AND NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = a.l_orderkey AND s.code = a.code AND s.y = a.y))
SELECT l_orderkey, code, y, num, vy, band FROM s UNION ALL SELECT * FROM w""")
def band_join_fallback(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_linenumber < 3").select("l_orderkey", c("l_linenumber").alias("code"), c("l_quantity").alias("y")).distinct()
    b = li.where("l_linenumber >= 3").select("l_orderkey", c("l_linenumber").alias("num"), c("l_quantity").alias("vy")).distinct()
    gap = c("y") - c("vy")
    return places.band_with_fallback(a, b, ["l_orderkey"], ["l_orderkey", "code", "y"], F.abs(gap) <= 1.5, gap.between(0, 8), 8.0, "y", "vy")


@query("SELECT p_partkey, prefix, priority FROM part JOIN (VALUES ('STANDARD', 1), ('SMALL', 2), ('PROMO', 3), ('STANDARD A', 4), ('S', 5)) v(prefix, priority) ON starts_with(p_type, prefix)")
def prefix_theta_join(spark, d):
    v = spark.createDataFrame([("STANDARD", 1), ("SMALL", 2), ("PROMO", 3), ("STANDARD A", 4), ("S", 5)], "prefix string, priority int")
    return places.prefix_join(v, table(spark, d, "part").select("p_partkey", "p_type"), "prefix", "p_type", [1, 5, 8, 10]).select("p_partkey", "prefix", "priority")


# --- documents ----------------------------------------------------------------------------------------------------------

_HEADS = "h AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS pos, (l_linenumber % 4 + 1)::INT AS level, 't' || l_linenumber AS title FROM lineitem)"


def _heads(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("doc"), F.row_number().over(w).cast("long").alias("pos"), (c("l_linenumber") % 4 + 1).alias("level"), F.concat(F.lit("t"), c("l_linenumber").cast("string")).alias("title"), F.lit(1000000).cast("long").alias("end"))


@query(f"WITH {_HEADS} SELECT doc, pos, coalesce(lead(pos) OVER (PARTITION BY doc ORDER BY pos), 1000000) AS span_end FROM h")
def direct_span(spark, d):
    return ordering.direct_span(_heads(spark, d), ["doc"], "pos", "end").select("doc", "pos", "span_end")


@query(f"WITH {_HEADS} SELECT a.doc, a.pos, coalesce((SELECT min(b.pos) FROM h b WHERE b.doc = a.doc AND b.pos > a.pos AND b.level <= a.level), 1000000) AS subtree_end FROM h a")
def subtree_span(spark, d):
    return ordering.subtree_span(_heads(spark, d), ["doc"], "pos", "level", "end").select("doc", "pos", "subtree_end")


@query(f"""WITH {_HEADS}, x AS (SELECT *, last_value(CASE WHEN level <= 1 THEN level END IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN level <= 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level <= 2 THEN level END IGNORE NULLS) OVER w AS l2, last_value(CASE WHEN level <= 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level <= 3 THEN level END IGNORE NULLS) OVER w AS l3, last_value(CASE WHEN level <= 3 THEN title END IGNORE NULLS) OVER w AS t3, last_value(CASE WHEN level <= 4 THEN level END IGNORE NULLS) OVER w AS l4, last_value(CASE WHEN level <= 4 THEN title END IGNORE NULLS) OVER w AS t4 FROM h WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc, pos, concat_ws(' > ', CASE WHEN level >= 1 AND l1 = 1 THEN t1 END, CASE WHEN level >= 2 AND l2 = 2 THEN t2 END, CASE WHEN level >= 3 AND l3 = 3 THEN t3 END, CASE WHEN level >= 4 AND l4 = 4 THEN t4 END) AS path FROM x""")
def heading_path(spark, d):
    return ordering.heading_path(_heads(spark, d), ["doc"], "pos", "level", "title").select("doc", "pos", F.array_join("path", " > ").alias("path"))


@query("""WITH pg AS (SELECT DISTINCT o_custkey % 50 AS sheet, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS page_no FROM orders), cd AS (SELECT o_custkey % 50 AS sheet, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS page_no, substr(o_orderpriority, 1, 1) AS code FROM orders),
r AS (SELECT *, page_no - row_number() OVER (PARTITION BY sheet ORDER BY page_no) AS run FROM pg), m AS (SELECT sheet, min(page_no) AS first_page, max(page_no) AS last_page, list_sort(list_distinct(list(code))) AS f FROM r JOIN cd USING (sheet, page_no) GROUP BY sheet, run)
SELECT sheet, first_page, last_page, array_to_string(f, ',') AS found, array_to_string(list_filter(['1','2','6'], lambda x: NOT list_contains(f, x)), ',') AS missing, array_to_string(list_filter(f, lambda x: NOT list_contains(['1','2','6'], x)), ',') AS unexpected FROM m""")
def expected_minus_found(spark, d):
    o = table(spark, d, "orders").select((c("o_custkey") % 50).alias("sheet"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("page_no"), F.substring("o_orderpriority", 1, 1).alias("code"))
    pages = o.groupBy("sheet", "page_no").agg(F.collect_set("code").alias("codes"))
    return documents.found_codes(pages, o.select("sheet").distinct().withColumn("expected", F.array(F.lit("1"), F.lit("2"), F.lit("6"))))


@query("""WITH x AS (SELECT l_orderkey AS row_key, n AS col_no, any_value(l_quantity) FILTER (l_linenumber = n) AS v FROM lineitem, range(1, 8) t(n) GROUP BY ALL), m AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN col_no END) OVER (PARTITION BY row_key) AS a, max(CASE WHEN v IS NOT NULL THEN col_no END) OVER (PARTITION BY row_key) AS b, count(v) OVER (PARTITION BY row_key) AS k FROM x)
SELECT row_key, col_no::INT AS col_no FROM m WHERE v IS NULL AND k >= 2 AND col_no BETWEEN a AND b""")
def column_gaps(spark, d):
    li = table(spark, d, "lineitem")
    grid = li.select(c("l_orderkey").alias("row_key")).distinct().select("row_key", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("col_no"))
    filled = li.select(c("l_orderkey").alias("row_key"), c("l_linenumber").alias("col_no")).distinct().withColumn("value", F.lit(1))
    return documents.column_gaps(grid.join(filled, ["row_key", "col_no"], "left"))


@query(f"WITH {_LINES}, x AS (SELECT doc_id, line_no, line, len(list_filter(string_split_regex(line, '\\s+'), lambda y: y <> '')) AS w FROM b) SELECT doc_id, line_no::INT AS chunk, w::INT AS words, w < 30 AS is_short, w > 700 AS is_long, NOT regexp_matches(line, '[.!?:;|)]\\s*$') AS cut_off, false AS private_use, count(*) OVER (PARTITION BY line) > 1 AS repeated, line_no % 7 > 3 AS page_jump FROM x")
def chunk_anomalies(spark, d):
    x = documents.lines(table(spark, d, "documents")).select("doc_id", c("line_no").alias("chunk"), c("line").alias("text"), F.array(F.lit(1).cast("bigint"), F.lit(1) + c("line_no") % 7).alias("pages"))
    out = documents.chunk_anomalies(x)
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("private_use", "page_jump")})


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
u AS MATERIALIZED (SELECT doc_id, line_no, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, i, line_no, 0 AS "group", n AS total FROM u WHERE i = 1
  UNION ALL SELECT u.doc_id, u.i, u.line_no, CASE WHEN w.total >= 400 AND w.total + u.n > 500 THEN w."group" + 1 ELSE w."group" END, CASE WHEN w.total >= 400 AND w.total + u.n > 500 THEN u.n ELSE w.total + u.n END FROM w JOIN u ON u.doc_id = w.doc_id AND u.i = w.i + 1)
SELECT doc_id, "group", min(line_no) AS first, max(line_no) AS last, max(total) AS total FROM w GROUP BY 1, 2""")
def greedy_chunks(spark, d):
    x = documents.lines(table(spark, d, "documents")).withColumn("n", text.word_count(c("line")))
    return ordering.greedy_groups(x, ["doc_id"], "line_no", "n", 400, 500)


@query("WITH r AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM r GROUP BY conv_id, k")
def islands_turns(spark, d):
    return ordering.islands(table(spark, d, "conversations"), ["conv_id"], "turn").groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("island")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS history_chars FROM conversations")
def conversation_window(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    last = w.rowsBetween(-10, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.count("*").over(last).alias("history"), F.coalesce(F.sum(F.length("text")).over(last), F.lit(0)).cast("long").alias("history_chars"))


@query("""WITH RECURSIVE ph AS MATERIALIZED (SELECT p_partkey AS ref, xor(('0x' || md5((p_partkey // 3)::VARCHAR)[1:15])::BIGINT, CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 240 ELSE 0 END::BIGINT) AS h FROM part),
ed AS MATERIALIZED (SELECT a.ref AS u, b.ref AS v FROM ph a JOIN ph b ON a.ref <> b.ref AND bit_count(xor(a.h, b.h)) <= 4),
rc AS (SELECT ref, ref AS r FROM ph UNION SELECT ed.v, rc.r FROM rc JOIN ed ON ed.u = rc.ref) SELECT ref, min(r) AS canonical FROM rc GROUP BY 1""")
def picture_clusters(spark, d):
    """Three parts share a picture's hash but for a few bits; the second differs from the others by too many for one step."""
    k = c("p_partkey")
    h = F.conv(F.substring(F.md5(F.floor(k / 3).cast("string")), 1, 15), 16, 10).cast("long")
    noise = F.when(k % 3 == 0, F.lit(5)).when(k % 3 == 1, F.lit(240)).otherwise(F.lit(0)).cast("long")
    return documents.hamming_clusters(table(spark, d, "part").select(k.alias("ref"), h.bitwiseXOR(noise).alias("phash")), 4)


# --- events -------------------------------------------------------------------------------------------------------------


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return ev.tumbling(ev.batch(table(spark, d, "events")))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT - k * 3600 AS window_start, count(*) AS n FROM events, range(0, 2) t(k) GROUP BY 1")
def events_sliding(spark, d):
    return ev.sliding(ev.batch(table(spark, d, "events")))


@query("WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, d):
    return ev.sessions(ev.batch(table(spark, d, "events")))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def events_latest_wins(spark, d):
    return ev.latest_by_user(table(spark, d, "events"))
