"""Exports as text cells, computed rows built anew, locators, paths, costs and texts for readers, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sources
from tessera.operators import exports
from tessera.operators.indicators import wide
from tessera.plans.fixtures import NAMES, companies, kpis
from tessera.plans.queries import CK, K, c, query
from tessera.session import table

ON = ["company_id", "kpi_name"]


def _cents(x):
    return F.floor(x * 100) / 100


def _number(x: str) -> str:
    return f"coalesce(replace(regexp_replace(regexp_replace(printf('%.3f', round({x}, 3)), '0+$', ''), '\\.$', ''), '.', ','), '')"


_CHOSEN = [(1, "first"), (7, "second"), (14, "third")]
_WARN = "CASE WHEN company_id % 2 = 0 AND kpi_name IN ('mcr', 'tier3') THEN 'Read from a summary; ' || kpi_name END"
_MINE = ", ".join(f"max(v) FILTER (company_id = {i}) AS v{i}, max(w) FILTER (company_id = {i}) AS w{i}" for i, _ in _CHOSEN)
_CELLS = ", ".join(f"CASE WHEN pl AND v{i} = 0 THEN 'n.a.' ELSE {_number(f'v{i}')} END AS {n}" for i, n in _CHOSEN)
_NOTES = ", ".join(f"'{n}: ' || w{i}" for i, n in _CHOSEN)


@query(K + f"""SELECT kpi_name, {_CELLS}, concat_ws(', ', {", ".join(f"CASE WHEN w{i} IS NOT NULL THEN '{n}' END" for i, n in _CHOSEN)}) AS warned,
CASE WHEN contains(concat_ws(' | ', {_NOTES}), ';') THEN '"' || concat_ws(' | ', {_NOTES}) || '"' ELSE concat_ws(' | ', {_NOTES}) END AS notes, CASE WHEN missing THEN 'compare with care' ELSE 'comparable' END AS verdict
FROM (SELECT kpi_name, {_MINE} FROM (SELECT *, floor(value * 100) / 100 AS v, {_WARN} AS w FROM kpis WHERE year = 1997) GROUP BY 1) JOIN (SELECT kpi_name, bool_or(value IS NULL) AS missing, kpi_name IN ('tier1_restricted', 'tier2', 'tier3', 'claims') AS pl FROM kpis GROUP BY ALL) USING (kpi_name)
WHERE coalesce({', '.join(f'v{i}' for i, _ in _CHOSEN)}) IS NOT NULL""")
def comparative_export(spark, d):
    """Three companies in one year, which the chart names."""
    k = kpis(spark, d)
    name = c("kpi_name")
    warning = F.when((c("company_id") % 2 == 0) & name.isin("mcr", "tier3"), F.concat(F.lit("Read from a summary; "), name))
    values = k.where("year = 1997").select(*ON, _cents(c("value")).alias("value"), warning.alias("warning"))
    verdicts = k.groupBy("kpi_name").agg(F.when(F.bool_or(c("value").isNull()), "R").otherwise("C").alias("verdict")).withColumn("pointless", name.isin("tier1_restricted", "tier2", "tier3", "claims"))
    return exports.comparative(values, _CHOSEN, verdicts, {"C": "comparable", "R": "compare with care", "N": "not comparable"})


@query(CK + f"""SELECT c.name AS company, n.kpi_name, {_number('v')} AS value, n.unit, CASE WHEN v IS NOT NULL AND c.company_id % 2 = 0 THEN {_number('v1000')} ELSE '' END AS raw_value, CASE WHEN v IS NOT NULL AND c.company_id % 2 = 0 THEN 'thousands' ELSE '' END AS raw_unit,
CASE WHEN v IS NOT NULL THEN source_page::VARCHAR ELSE '' END AS page, CASE WHEN validated THEN '' WHEN k.kpi_name = 'mcr' THEN 'not comparable' ELSE '' END AS warned, CASE WHEN validated THEN '' WHEN k.kpi_name = 'mcr' THEN '''=not read again' ELSE '' END AS note
FROM companies c CROSS JOIN (SELECT DISTINCT kpi_name, unit FROM kpis) n LEFT JOIN (SELECT *, floor(value * 100) / 100 AS v, floor(value * 100) * 10 AS v1000 FROM kpis WHERE year = 1998) k ON k.company_id = c.company_id AND k.kpi_name = n.kpi_name""")
def whole_export(spark, d):
    """Every company and indicator; the notes of some start as a formula would."""
    warning = F.when((c("kpi_name") == "mcr") & ~c("validated"), "=not read again")
    even = c("company_id") % 2 == 0
    values = kpis(spark, d).where("year = 1998").select(*ON, _cents(c("value")).alias("value"), F.when(even, (F.floor(c("value") * 100) * 10).cast("double")).alias("raw_value"), F.when(even, "thousands").alias("raw_unit"), "source_page", warning.alias("warning"))
    return exports.whole_rows(companies(spark, d), [(n, "pct" if n == "ratio_scr" else "MEUR") for n in NAMES], values)


@query(K + """, m AS (SELECT company_id, year, own_funds, scr_total, own_funds - scr_total AS v FROM p WHERE own_funds IS NOT NULL AND scr_total IS NOT NULL)
SELECT 'kpis' AS place, company_id, year, kpi_name, value FROM kpis UNION ALL SELECT 'kpis', company_id, year, 'margin', v FROM m
UNION ALL SELECT 'components', company_id, year, 'margin', own_funds FROM m UNION ALL SELECT 'components', company_id, year, 'margin', scr_total FROM m
UNION ALL SELECT 'components', company_id, year, 'own_funds', tier1 FROM p UNION ALL SELECT 'formulas', company_id, year, 'margin', NULL FROM m""")
def computed_rebuilt(spark, d):
    """Rows of an earlier run lie in all three tables; building twice is building once."""
    k = kpis(spark, d).select("company_id", "year", "kpi_name", "value")
    w = wide(k, ["own_funds", "scr_total", "tier1"])
    key, margin = ["company_id", "year"], F.lit("margin").alias("kpi_name")
    whole = w.where("own_funds IS NOT NULL AND scr_total IS NOT NULL")
    none = F.lit(None).cast("double").alias("value")
    parts = whole.select(*key, margin, F.explode(F.array("own_funds", "scr_total")).alias("value"))
    made = {"kpis": whole.select(*key, margin, (c("own_funds") - c("scr_total")).alias("value")), "components": parts, "formulas": whole.select(*key, margin, none)}
    stale = w.where("company_id % 3 = 0").select(*key, margin, F.lit(-1.0).alias("value"))
    tables = {"kpis": k.union(stale), "components": w.select(*key, F.lit("own_funds").alias("kpi_name"), c("tier1").alias("value")).union(stale), "formulas": stale}
    out = exports.rebuilt(exports.rebuilt(tables, made, ["margin"]), made, ["margin"])
    at = lambda n: out[n].select(F.lit(n).alias("place"), *key, "kpi_name", "value")
    return at("kpis").union(at("components")).union(at("formulas"))


# --- locators, paths, costs -------------------------------------------------------------------------------------------


@query(r"""WITH q AS (SELECT doc_id, doc_id // 50 AS b, text FROM documents), g AS (SELECT CASE WHEN b % 3 = 2 THEN 1000000 + doc_id // 10 ELSE b END AS doc, CASE WHEN b % 3 = 2 THEN doc_id % 10 ELSE doc_id % 50 END + 1 AS page_no, b FROM q),
h AS (SELECT DISTINCT doc, page_no FROM g WHERE page_no >= 50 - 8 * (doc % 6) OR (doc % 4 = 1 AND page_no = 3) OR (doc > 1000000 AND page_no > 7)),
s AS (SELECT doc, max(page_no) AS n FROM g GROUP BY 1),
t AS (SELECT doc, n, w, greatest(1, n - w + 1) AS start, (SELECT min(page_no) FROM h WHERE h.doc = s.doc AND page_no >= greatest(1, n - w + 1)) AS first FROM s, (SELECT unnest([20, 40, 80]) AS w) WHERE w <= n),
u AS (SELECT doc, coalesce(min(w) FILTER (first > start), max(w)) AS w FROM t GROUP BY 1),
f AS (SELECT doc, 'scan' AS method, page_no FROM h UNION SELECT h.doc, 'tail', page_no FROM h JOIN u USING (doc) JOIN s USING (doc) WHERE page_no >= n - w + 1
  UNION SELECT doc, 'contents', 50 - 8 * (doc % 6) FROM g WHERE page_no = 2),
r AS (SELECT doc, method, count(*) AS pages, count(*) FILTER ((doc, page_no) IN (SELECT (doc, page_no) FROM h)) AS hit FROM f GROUP BY ALL),
e AS (SELECT doc, method, coalesce(pages, 0) AS pages, (SELECT count(*) FROM h WHERE h.doc = s.doc) - coalesce(hit, 0) AS missing FROM s CROSS JOIN (SELECT unnest(['contents', 'tail', 'scan']) AS method) LEFT JOIN r USING (doc, method))
SELECT doc, method, pages, missing, missing = 0 AND pages > 0 AS reliable FROM e""")
def template_locators(spark, d):
    """Fifty documents, or ten of some, are the pages of a report; its last ones hold templates, some an early one too."""
    b = F.floor(c("doc_id") / 50)
    short = b % 3 == 2
    doc, page = F.when(short, F.floor(c("doc_id") / 10) + 1000000).otherwise(b), (F.when(short, c("doc_id") % 10).otherwise(c("doc_id") % 50) + 1).cast("int")
    g = table(spark, d, "documents").select(doc.alias("doc"), page.alias("page_no"), c("text").alias("body"))
    start = 50 - 8 * (c("doc") % 6)
    hit = (c("page_no") >= start) | ((c("doc") % 4 == 1) & (c("page_no") == 3)) | ((c("doc") > 1000000) & (c("page_no") > 7))
    text = F.concat(F.coalesce("body", F.lit("")), F.when(hit, "\nS.23.01.01 Own funds").otherwise(""), F.when(c("page_no") == 2, F.concat(F.lit("\nQuantitative templates ..... "), start.cast("string"))).otherwise(""))
    return exports.template_locators(g.select("doc", "page_no", text.alias("text")), r"\bS\.\d{2}\.\d{2}\.\d{2}\b", r"(?i)quantitative templates", r"(\d+)$")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '2025/tables/table_' || p_partkey || '.png' WHEN 1 THEN '2025/images/picture_' || p_partkey || '.png' END AS path, '2025/pages/page_' || p_size || '.png' AS page FROM part")
def visual_paths(spark, d):
    k = c("p_size") % 4
    ref = F.concat(F.when(k == 0, "#/tables/0").when(k == 1, "#/pictures/").when(k == 2, "#/groups/").otherwise("tables/"), c("p_partkey").cast("string"))
    year = F.lit(2025)
    return table(spark, d, "part").select("p_partkey", exports.visual_path(ref, year).alias("path"), exports.page_path(c("p_size"), year).alias("page"))


@query(r"""SELECT conv_id, count(*) FILTER (role = 'assistant') AS answers, sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS tokens_out,
sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::DOUBLE * 1.0 / 1000000 + sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::DOUBLE * 5.0 / 1000000 AS cost FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM conversations) GROUP BY 1""")
def answer_costs(spark, d):
    """Words stand for tokens."""
    n, said = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.coalesce(c("role") == "assistant", F.lit(False))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(said).alias("answers"), F.sum(F.when(said, 0).otherwise(n)).alias("tokens_in"), F.sum(F.when(said, n).otherwise(0)).alias("tokens_out"))
    return g.withColumn("cost", exports.answer_cost(c("tokens_in"), c("tokens_out"), 1.0, 5.0))


# --- texts for readers ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5('fi ff12 ' || replace(replace(text, 'e ', 'ﬃ '), 'ﬃ', 'ffi')) AS text FROM documents")
def compatible_texts(spark, d):
    """Every text with ligatures, wide digits and no-break spaces put in."""
    odd = F.concat(F.lit("\ufb01\u00a0\ufb00\uff11\uff12\u202f"), F.replace("text", F.lit("e "), F.lit("\ufb03 ")))
    return table(spark, d, "documents").select("doc_id", F.md5(sources.compatible(odd)).alias("text"))


_TABLES = {"02.01": "balance sheet", "23.01": "own funds", "25.01": "requirement by the standard formula"}
_CHAPTERS = {"D.2": "technical provisions", "E.1": "own funds"}
_NOTES_OF = [(r"rendered image", "read from a picture"), (r"(\d+) lines found", "$1 lines read"), (r"printed '-'", "an empty cell counts as zero"), (r"confirmed p\.(\d+)", "compared with page $1"), (r"sum of the tiers", "the tiers add up to the total")]


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS k, l_partkey % 6 AS m, CASE l_suppkey % 7 WHEN 0 THEN 'S.23.01.01' WHEN 1 THEN 'S.25.01.22.01' WHEN 2 THEN 'D.2 — text' WHEN 3 THEN 'Kept by hand' WHEN 4 THEN 'NULL: within another item' WHEN 5 THEN 'S.99.01.01' ELSE 'S.02.01.02' END AS place FROM lineitem),
n AS (SELECT *, CASE k WHEN 0 THEN 'Official table S.23.01 (own funds)' WHEN 1 THEN 'Official table S.25.01 (requirement by the standard formula of the group)' WHEN 2 THEN 'Report, chapter D.2 (technical provisions)' WHEN 6 THEN 'Official table S.02.01 (balance sheet)' END AS said,
  CASE m WHEN 0 THEN '' WHEN 1 THEN ' — read from a picture' WHEN 2 THEN ' — ' || l_linenumber || ' lines read; compared with page 12' WHEN 3 THEN ' — an empty cell counts as zero' WHEN 4 THEN ' — the tiers add up to the total' ELSE '' END AS notes FROM t)
SELECT l_orderkey, l_linenumber, CASE k WHEN 4 THEN 'No figure of its own.' ELSE said || notes END AS text, CASE WHEN k IN (3, 5) THEN 'unknown place' END AS fault FROM n""")
def simple_sources(spark, d):
    k, m = c("l_suppkey") % 7, c("l_partkey") % 6
    place = F.when(k == 0, "S.23.01.01").when(k == 1, "S.25.01.22.01").when(k == 2, "D.2 — text").when(k == 3, "Kept by hand").when(k == 4, "NULL: within another item").when(k == 5, "S.99.01.01").otherwise("S.02.01.02")
    place = F.when(k == 1, "S.25.01.22").otherwise(place)
    trace = F.concat(place, F.when(m == 1, " R0010 rendered image, rendered image").when(m == 2, F.concat(F.lit(" C0010, "), c("l_linenumber").cast("string"), F.lit(" lines found, confirmed p.12 and p.13"))).when(m == 3, " printed '-'").when(m == 4, " tier_1: sum of the tiers = total").otherwise(" own_funds"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", trace.alias("trace"))
    said = sources.simple_source(c("trace"), [("NULL: within", "No figure of its own.")], _TABLES, _CHAPTERS, _NOTES_OF)
    return x.select("l_orderkey", "l_linenumber", said.alias("said")).select("l_orderkey", "l_linenumber", "said.*")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Premiums of ' || p_name WHEN p_name LIKE '%premiu%' THEN p_name ELSE 'Premiums: ' || p_name END AS label, p_size % 5 = 0 OR p_size % 5 = 1 AS technical FROM part")
def prefixed_labels(spark, d):
    label = F.concat(F.when(c("p_size") % 3 == 0, "Premiums of ").otherwise(""), "p_name", F.lit(" [read again]"))
    text = F.concat("p_name", F.when(c("p_size") % 5 == 0, " see own_funds").when(c("p_size") % 5 == 1, " in S.23.01").when(c("p_size") % 5 == 2, " in official table S.23.01 (own funds)").otherwise(""))
    return table(spark, d, "part").select("p_partkey", sources.prefixed_label(label, "Premiums").alias("label"), sources.technical(text, r"(?i)official table S\.\d{2}\.\d{2}\b").alias("technical"))
