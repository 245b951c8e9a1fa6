"""Company indicators laid over the star schema, for the domain operators; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

NAMES = ["own_funds", "tier1", "tier1_restricted", "tier2", "tier3", "scr_total", "mcr", "ratio_scr", "best_estimate", "risk_margin", "technical_provisions", "premiums", "claims"]
CATEGORY = {"own_funds": "funds", "tier1": "funds", "tier1_restricted": "funds", "tier2": "funds", "tier3": "funds", "scr_total": "capital", "mcr": "capital", "ratio_scr": "capital", "best_estimate": "provisions", "risk_margin": "provisions", "technical_provisions": "provisions", "premiums": "activity", "claims": "activity"}
ACTIVITY = {"BUILDING": "life", "AUTOMOBILE": "non-life", "MACHINERY": "health", "HOUSEHOLD": "composite", "FURNITURE": "composite"}


def companies(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    activity = F.create_map(*[F.lit(x) for p in ACTIVITY.items() for x in p])
    parent = F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") + 1)
    return c.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), activity[F.col("c_mktsegment")].alias("activity"), F.when(F.col("c_acctbal") < 0, "internal").otherwise("standard").alias("model"), F.when(F.col("c_nationkey") % 2 == 0, "solo").otherwise("group").alias("perimeter"), parent.alias("parent_id"), (F.col("c_custkey") % 20).alias("selection"), (F.col("c_custkey") % 23 == 0).alias("warned"))


def kpis(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, year, category, kpi_name, value, unit, source_page, validated), with nulls and broken identities on purpose."""
    money = F.col("o_totalprice").cast("decimal(18,2)")
    level = F.substring("o_orderpriority", 1, 1)
    tier = lambda x: F.coalesce(F.sum(F.when(x, money)), F.lit(0).cast("decimal(18,2)")).cast("double")
    g = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year")).agg(F.sum(money).cast("double").alias("t"), tier(level == "1").alias("t1"), tier(level == "2").alias("t2"), tier(level == "3").alias("t3"), tier(level > "3").alias("t4"), F.count("*").alias("n"))
    c, t, k = F.col, F.col("t"), F.col("company_id")
    v = {
        "own_funds": F.when(k % 13 == 0, t / 1000 + 5).otherwise(t / 1000), "tier1": c("t1") / 1000, "tier1_restricted": c("t2") / 1000, "tier2": c("t3") / 1000, "tier3": c("t4") / 1000,
        "scr_total": t * (40 + k % 60) / 100000, "mcr": F.when(k % 19 != 0, t * (10 + k % 20) / 100000), "ratio_scr": F.when(k % 17 == 0, 100000 / (40.0 + k % 60) / 10 + 3).otherwise(100000 / (40.0 + k % 60) / 10),
        "best_estimate": t * 2 / 1000, "risk_margin": t * 5 / 100000, "technical_provisions": t * 2 / 1000 + t * 5 / 100000, "premiums": F.when(k % 11 != 0, c("n") * 50.0), "claims": c("t1") / 1000,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(CATEGORY[n]).alias("category"), F.lit(n).alias("kpi_name"), F.round(v[n], 8).alias("value")) for n in NAMES]))
    out = g.select("company_id", "year", rows.alias("r")).select("company_id", "year", "r.*")
    return out.select("*", F.when(F.col("kpi_name") == "ratio_scr", "pct").otherwise("MEUR").alias("unit"), (k % 40 + 1).cast("int").alias("source_page"), (k % 3 == 0).alias("validated"))


#: The same as common table expressions.
COMPANIES_SQL = """companies AS (SELECT c_custkey AS company_id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'life' WHEN 'AUTOMOBILE' THEN 'non-life' WHEN 'MACHINERY' THEN 'health' ELSE 'composite' END AS activity,
  CASE WHEN c_acctbal < 0 THEN 'internal' ELSE 'standard' END AS model, CASE WHEN c_nationkey % 2 = 0 THEN 'solo' ELSE 'group' END AS perimeter,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 END AS parent_id, c_custkey % 20 AS selection, c_custkey % 23 = 0 AS warned FROM customer)"""
KPIS_SQL = """g AS (SELECT o_custkey AS company_id, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS t,
  coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority LIKE '1%'), 0)::DOUBLE AS t1, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority LIKE '2%'), 0)::DOUBLE AS t2,
  coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderpriority LIKE '3%'), 0)::DOUBLE AS t3, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (substr(o_orderpriority, 1, 1) > '3'), 0)::DOUBLE AS t4, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT company_id, year, CASE WHEN company_id % 13 = 0 THEN t / 1000 + 5 ELSE t / 1000 END AS own_funds, t1 / 1000 AS tier1, t2 / 1000 AS tier1_restricted, t3 / 1000 AS tier2, t4 / 1000 AS tier3,
  t * (40 + company_id % 60) / 100000 AS scr_total, CASE WHEN company_id % 19 <> 0 THEN t * (10 + company_id % 20) / 100000 END AS mcr,
  CASE WHEN company_id % 17 = 0 THEN 100000 / (40.0::DOUBLE + company_id % 60) / 10 + 3 ELSE 100000 / (40.0::DOUBLE + company_id % 60) / 10 END AS ratio_scr,
  t * 2 / 1000 AS best_estimate, t * 5 / 100000 AS risk_margin, t * 2 / 1000 + t * 5 / 100000 AS technical_provisions, CASE WHEN company_id % 11 <> 0 THEN n * 50.0::DOUBLE END AS premiums, t1 / 1000 AS claims FROM g),
u AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (v FOR kpi_name IN (own_funds, tier1, tier1_restricted, tier2, tier3, scr_total, mcr, ratio_scr, best_estimate, risk_margin, technical_provisions, premiums, claims))),
kpis AS (SELECT company_id, year, CASE WHEN kpi_name IN ('scr_total','mcr','ratio_scr') THEN 'capital' WHEN kpi_name IN ('best_estimate','risk_margin','technical_provisions') THEN 'provisions' WHEN kpi_name IN ('premiums','claims') THEN 'activity' ELSE 'funds' END AS category,
  kpi_name, round(v, 8) AS value, CASE WHEN kpi_name = 'ratio_scr' THEN 'pct' ELSE 'MEUR' END AS unit, (company_id % 40 + 1)::INT AS source_page, company_id % 3 = 0 AS validated FROM u),
p AS (SELECT company_id, year, max(value) FILTER (kpi_name='own_funds') own_funds, max(value) FILTER (kpi_name='tier1') tier1, max(value) FILTER (kpi_name='tier1_restricted') tier1_restricted, max(value) FILTER (kpi_name='tier2') tier2,
  max(value) FILTER (kpi_name='tier3') tier3, max(value) FILTER (kpi_name='scr_total') scr_total, max(value) FILTER (kpi_name='mcr') mcr, max(value) FILTER (kpi_name='ratio_scr') ratio_scr, max(value) FILTER (kpi_name='best_estimate') best_estimate,
  max(value) FILTER (kpi_name='risk_margin') risk_margin, max(value) FILTER (kpi_name='technical_provisions') technical_provisions, max(value) FILTER (kpi_name='premiums') premiums, max(value) FILTER (kpi_name='claims') claims FROM kpis GROUP BY ALL)"""
