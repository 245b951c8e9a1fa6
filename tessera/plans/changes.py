"""Queries of guarded patches, typed corrections, and streams that repeat themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import patches
from tessera.plans.fixtures import KPIS_SQL, kpis
from tessera.plans.queries import K, c, query
from tessera.session import table
from tessera.streaming import events as ev

KEY = ["company_id", "year", "kpi_name"]

# --- patches ------------------------------------------------------------------------------------------------------------


def _figures(spark, d) -> DataFrame:
    """The fixture's figures; claims of every fiftieth company are there twice."""
    k = kpis(spark, d).select(*KEY, "value", "unit", "source_page")
    return k.unionByName(k.where("kpi_name = 'claims' AND company_id % 50 = 0"))


def _text_map(**values) -> F.Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("string"))])


def _patches(spark, d) -> DataFrame:
    """Steps: fill a missing figure, then its page; units with a wrong guard and with none; a set value seen again; zeros
    deleted and touched after; keys that no row or two rows have."""
    text_map = "map<string,string>"
    none = F.lit(None).cast(text_map)

    def some(when: str, name: str, step: int, action: str = "set", guards: dict | None = None, sets: dict | None = None):
        return F.when(F.expr(when), F.struct(F.lit(step).alias("step"), F.lit(name).alias("kpi_name"), F.lit(action).alias("action"), (_text_map(**guards).cast(text_map) if guards else none).alias("guards"), (_text_map(**sets).cast(text_map) if sets else none).alias("sets")))

    rows = [
        some("true", "mcr", 1, guards={"value": None}, sets={"value": "12.5", "unit": "EUR"}),
        some("true", "mcr", 2, guards={"value": "12.5", "unit": "EUR"}, sets={"source_page": "7"}),
        some("company_id % 4 = 0", "scr_total", 3, guards={"unit": "pct"}, sets={"unit": "x"}),
        some("company_id % 4 = 1", "scr_total", 3, sets={"unit": "thousands", "value": None}),
        some("company_id % 2 = 1", "scr_total", 4, guards={"unit": "thousands"}, sets={"unit": "MEUR"}),
        some("true", "tier3", 5, "delete", guards={"value": "0.0"}),
        some("company_id % 3 = 0", "tier3", 6, sets={"source_page": "1"}),
        some("company_id % 10 = 0", "claims", 7, sets={"value": "1"}),
        some("company_id % 7 = 0", "no_such", 8, sets={"value": "1"}),
    ]
    key = table(spark, d, "orders").select(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year")).distinct()
    out = key.select("company_id", "year", F.explode(F.array_compact(F.array(*rows))).alias("p")).select("company_id", "year", "p.*")
    return out.withColumn("patch_id", c("company_id") * 100000 + c("year") * 10 + c("step"))


_PATCHED = """f AS (SELECT company_id, year, kpi_name, value, unit, source_page FROM kpis UNION ALL SELECT company_id, year, kpi_name, value, unit, source_page FROM kpis WHERE kpi_name = 'claims' AND company_id % 50 = 0),
t AS (SELECT company_id, year, kpi_name,
  CASE WHEN kpi_name = 'mcr' AND value IS NULL THEN 12.5 WHEN kpi_name = 'scr_total' AND company_id % 4 = 1 THEN NULL WHEN kpi_name = 'claims' AND company_id % 10 = 0 AND company_id % 50 <> 0 THEN 1.0 ELSE value END AS value,
  CASE WHEN kpi_name = 'mcr' AND value IS NULL THEN 'EUR' ELSE unit END AS unit,
  CASE WHEN kpi_name = 'mcr' AND value IS NULL THEN 7 WHEN kpi_name = 'tier3' AND company_id % 3 = 0 THEN 1 ELSE source_page END AS source_page FROM f WHERE NOT (kpi_name = 'tier3' AND value = 0))"""


@query(f"{K}, {_PATCHED} SELECT * FROM t")
def patched_figures(spark, d):
    return patches.apply(_figures(spark, d), _patches(spark, d), KEY, ["value", "unit", "source_page"]).table


_JOURNAL = """j AS (
 SELECT 1 AS step, company_id, year, kpi_name, CASE WHEN value IS NULL THEN 'applied' ELSE 'refused' END AS status, 1 AS rows, CASE WHEN value IS NULL THEN unit END AS old_unit FROM kpis WHERE kpi_name = 'mcr'
 UNION ALL SELECT 2, company_id, year, kpi_name, CASE WHEN value IS NULL THEN 'applied' ELSE 'refused' END, 1, NULL FROM kpis WHERE kpi_name = 'mcr'
 UNION ALL SELECT 3, company_id, year, kpi_name, CASE WHEN company_id % 4 = 1 THEN 'applied' ELSE 'refused' END, 1, CASE WHEN company_id % 4 = 1 THEN unit END FROM kpis WHERE kpi_name = 'scr_total' AND company_id % 4 < 2
 UNION ALL SELECT 4, company_id, year, kpi_name, CASE WHEN company_id % 4 = 1 THEN 'applied' ELSE 'refused' END, 1, CASE WHEN company_id % 4 = 1 THEN 'thousands' END FROM kpis WHERE kpi_name = 'scr_total' AND company_id % 2 = 1
 UNION ALL SELECT 5, company_id, year, kpi_name, CASE WHEN value = 0 THEN 'applied' ELSE 'refused' END, 1, NULL FROM kpis WHERE kpi_name = 'tier3'
 UNION ALL SELECT 6, company_id, year, kpi_name, CASE WHEN value = 0 THEN 'absent' ELSE 'applied' END, 1, NULL FROM kpis WHERE kpi_name = 'tier3' AND company_id % 3 = 0
 UNION ALL SELECT 7, company_id, year, kpi_name, CASE WHEN company_id % 50 = 0 THEN 'ambiguous' ELSE 'applied' END, CASE WHEN company_id % 50 = 0 THEN 2 ELSE 1 END, NULL FROM kpis WHERE kpi_name = 'claims' AND company_id % 10 = 0
 UNION ALL SELECT 8, company_id, year, 'no_such', 'absent', 0, NULL FROM p WHERE company_id % 7 = 0)"""


@query(f"{K}, {_JOURNAL} SELECT company_id * 100000 + year * 10 + step AS patch_id, step, company_id, year, kpi_name, status, rows::BIGINT AS rows, old_unit FROM j")
def patch_journal(spark, d):
    j = patches.apply(_figures(spark, d), _patches(spark, d), KEY, ["value", "unit", "source_page"]).journal
    return j.select("patch_id", "step", *KEY, "status", "rows", c("before")["unit"].alias("old_unit"))


@query(f"{K}, {_JOURNAL} SELECT step, status, count(*) AS patches FROM j GROUP BY ALL")
def patch_counters(spark, d):
    return patches.counters(patches.apply(_figures(spark, d), _patches(spark, d), KEY, ["value", "unit", "source_page"]).journal)


def _typed(spark, d) -> DataFrame:
    """Events as corrections: a user is a company, the type an indicator; some texts aren't figures, some units unknown."""
    e = table(spark, d, "events")
    name = F.when(c("event_type") == "view", "own_funds").when(c("event_type") == "click", "mcr").when(c("event_type") == "error", "no_such").otherwise("premiums")
    cents = F.floor(F.abs(c("value")) * 100 + 0.5).cast("long")
    grouped = F.replace(F.format_number(F.floor(cents / 100), 0), F.lit(","), F.lit(" "))
    text = F.when(c("event_id") % 9 == 0, F.concat(grouped, F.lit(" or so"))).otherwise(F.concat(grouped, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")))
    unit = F.when(c("event_id") % 7 == 0, "dozens").when(c("event_id") % 2 == 0, "thousands").otherwise("millions")
    return e.select(c("user_id").alias("company_id"), name.alias("kpi_name"), text.alias("text"), unit.alias("unit"), c("event_id").cast("string").alias("comment"), F.struct("ts", "event_id").alias("ts"))


def _typed_result(spark, d) -> patches.Patched:
    rows = kpis(spark, d).select("company_id", "kpi_name", "year", "value", F.lit(None).cast("double").alias("raw_value"), "validated")
    return patches.typed_corrections(rows, _typed(spark, d), numbers.user_number, numbers.unit_divisor, ["company_id", "kpi_name"])


_TYPED = """ty AS (SELECT user_id AS company_id, CASE event_type WHEN 'view' THEN 'own_funds' WHEN 'click' THEN 'mcr' WHEN 'error' THEN 'no_such' ELSE 'premiums' END AS kpi_name, event_id, ts,
  CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 THEN NULL ELSE (floor(abs(value) * 100 + 0.5)::BIGINT / 100::DOUBLE) / CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1 END END AS nv FROM events),
ly AS (SELECT company_id, kpi_name, max(year) AS year FROM kpis GROUP BY ALL), rd AS (SELECT ty.*, ly.year FROM ty LEFT JOIN ly USING (company_id, kpi_name)),
be AS (SELECT company_id, kpi_name, year, max({'ts': ts, 'event_id': event_id, 'nv': nv}) AS b FROM rd WHERE year IS NOT NULL AND nv IS NOT NULL GROUP BY ALL)"""


@query(f"{K}, {_TYPED} SELECT company_id, kpi_name, year, CASE WHEN b IS NOT NULL THEN b.nv ELSE value END AS value, CASE WHEN b IS NOT NULL THEN value END AS raw_value, validated OR b IS NOT NULL AS validated FROM kpis LEFT JOIN be USING (company_id, kpi_name, year)")
def typed_figures_written(spark, d):
    return _typed_result(spark, d).table


@query(f"{K}, {_TYPED} SELECT rd.company_id, rd.kpi_name, rd.year, value AS old_value, nv AS new_value, rd.event_id::VARCHAR AS comment, CASE WHEN rd.year IS NULL THEN 'unknown' WHEN nv IS NULL THEN 'unreadable' WHEN b.event_id = rd.event_id THEN 'written' ELSE 'replaced' END AS state FROM rd LEFT JOIN kpis USING (company_id, kpi_name, year) LEFT JOIN be USING (company_id, kpi_name, year)")
def typed_corrections_log(spark, d):
    return _typed_result(spark, d).journal.drop("ts")


# --- streams that repeat themselves --------------------------------------------------------------------------------------


def repeated(events: DataFrame) -> DataFrame:
    """Every tenth event comes again five minutes later, every twentieth a third time."""
    again = lambda n, minutes: events.where(c("event_id") % n == 0).withColumn("ts", c("ts") + F.expr(f"interval {minutes} minutes"))
    return events.unionByName(again(10, 5)).unionByName(again(20, 8))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS second, user_id, event_type, value FROM events")
def events_deduplicated(spark, d):
    e = repeated(ev.batch(table(spark, d, "events")))
    return ev.deduplicated(e, ["event_id"]).select("event_id", F.unix_timestamp("ts").alias("second"), "user_id", "event_type", "value")


@query("""WITH l AS (SELECT user_id AS c_custkey, arg_max({'v': value, 'gone': event_type = 'error'}, (ts::DATE, ts, event_id)) AS l FROM events GROUP BY 1)
SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey, c_name, CASE WHEN l IS NOT NULL THEN l.v ELSE c_acctbal END AS c_acctbal FROM customer c FULL JOIN l ON c.c_custkey = l.c_custkey WHERE l IS NULL OR NOT l.gone""")
def corrections_merged(spark, d):
    """Balances with a log of corrections, a batch a day; a user's last event is the balance, an error takes the customer away."""
    log = table(spark, d, "events").select(c("user_id").alias("c_custkey"), F.datediff("ts", F.lit("2000-01-01")).cast("long").alias("batch"), "ts", "event_id", F.when(c("event_type") == "error", "delete").otherwise("set").alias("op"), c("value").alias("c_acctbal"))
    return ev.merged(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), log, ["c_custkey"], ["ts", "event_id"], ["c_acctbal"])
