"""Queries on what reports hold, over documents whose lines are pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import documents, inventory
from tessera.plans.queries import c, query
from tessera.session import table

COVER = {"year": r"(?i)31\s+december\s+(\d{4})", "entity": r"GROUP\s+([A-Z]+)"}
BLOCKING = ["missing code", "empty entity"]


def _numbered(spark, d) -> DataFrame:
    x = documents.lines(table(spark, d, "documents"))
    return x.select(c("doc_id").alias("doc"), (c("line_no") + 1).alias("page_no"), "line")


def report(spark, d) -> DataFrame:
    """A page a line, with codes, annexes, headings and cover facts by place."""
    n, k = c("page_no"), c("doc")
    two = F.lpad((n % 3 + 1).cast("string"), 2, "0")
    body = (
        F.when(n % 9 == 0, F.concat(F.lit("Annex "), (n % 4).cast("string"), F.lit(" - S.02.0"), (n % 7).cast("string"), F.lit(".01, annex 9: S.05.0"), (k % 5).cast("string"), F.lit(".02\n"), "line"))
        .when(n % 6 == 1, F.concat(F.lit("S.23.01."), F.when(k % 3 == 0, "22").otherwise("01"), F.lit(" and S.25."), two, F.lit(".21\n"), F.when(k % 2 == 0, F.lit("R0010 ")).otherwise(F.lit("")), "line"))
        .when(n % 5 == 2, F.concat(F.lit("## B."), (n % 8).cast("string"), F.lit(" First part\ntext\n### C."), (k % 6).cast("string"), F.lit(".2. Second part\n"), "line"))
        .when(n == 3, F.concat(F.lit("as of 31  December "), (2000 + k % 25).cast("string"), F.lit(" GROUP "), F.upper(F.translate(k.cast("string"), "0123456789", "abcdefghij")), F.lit("\n"), "line")).otherwise(c("line"))
    )
    return _numbered(spark, d).select("doc", "page_no", body.alias("text"))


_REPORT = r"""nl AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
rp AS MATERIALIZED (SELECT doc, n AS page_no, CASE WHEN n % 9 = 0 THEN 'Annex ' || n % 4 || ' - S.02.0' || n % 7 || '.01, annex 9: S.05.0' || doc % 5 || '.02' || chr(10) || line
  WHEN n % 6 = 1 THEN 'S.23.01.' || CASE WHEN doc % 3 = 0 THEN '22' ELSE '01' END || ' and S.25.' || lpad((n % 3 + 1)::VARCHAR, 2, '0') || '.21' || chr(10) || CASE WHEN doc % 2 = 0 THEN 'R0010 ' ELSE '' END || line
  WHEN n % 5 = 2 THEN '## B.' || n % 8 || ' First part' || chr(10) || 'text' || chr(10) || '### C.' || doc % 6 || '.2. Second part' || chr(10) || line
  WHEN n = 3 THEN 'as of 31  December ' || 2000 + doc % 25 || ' GROUP ' || upper(translate(doc::VARCHAR, '0123456789', 'abcdefghij')) || chr(10) || line ELSE line END AS text FROM nl WHERE trim(line) <> ''),
tp AS MATERIALIZED (SELECT doc, page_no, t AS template, min(i) AS i, any_value(length(text)) AS n_chars FROM (SELECT *, unnest(regexp_extract_all(text, '[A-Z]\.\d{2}\.\d{2}(\.\d{2})?')) AS t, unnest(range(len(regexp_extract_all(text, '[A-Z]\.\d{2}\.\d{2}(\.\d{2})?')))) AS i FROM rp) GROUP BY ALL)"""


@query(rf"""WITH {_REPORT}, an AS (SELECT doc, page_no, unnest(regexp_extract_all(text, '(?i)annex\s+(\d+)\s*[:–-]\s*([A-Z]\.\d{{2}}\.\d{{2}}(\.\d{{2}})?)', 1))::INT AS annex, unnest(regexp_extract_all(text, '(?i)annex\s+(\d+)\s*[:–-]\s*([A-Z]\.\d{{2}}\.\d{{2}}(\.\d{{2}})?)', 2)) AS code, unnest(range(len(regexp_extract_all(text, '(?i)annex\s+(\d+)\s*[:–-]\s*([A-Z]\.\d{{2}}\.\d{{2}}(\.\d{{2}})?)')))) AS i FROM rp) SELECT doc, annex, arg_max(code, (page_no, i)) AS code FROM an GROUP BY ALL""")
def annex_index(spark, d):
    return inventory.annexes(report(spark, d))


@query(f"WITH {_REPORT} SELECT doc, page_no, template, (row_number() OVER (PARTITION BY doc, page_no ORDER BY i) - 1)::INT AS place, n_chars::INT AS n_chars FROM tp")
def template_pages(spark, d):
    return inventory.template_pages(report(spark, d))


@query(f"WITH {_REPORT} SELECT doc, template, count(DISTINCT page_no) AS pages, count(*) FILTER (n_chars > 500) AS native, CASE WHEN bool_and(n_chars > 500) THEN 'native' WHEN bool_or(n_chars > 500) THEN 'mixed' ELSE 'image' END AS format FROM tp GROUP BY ALL")
def template_inventory(spark, d):
    return inventory.inventory(inventory.template_pages(report(spark, d)))


@query(rf"""WITH {_REPORT}, pf AS (SELECT doc, min(template) FILTER (template LIKE 'S.23.01%') AS f, bool_or(template LIKE 'S.25.01%') AS st, bool_or(regexp_matches(template, '^S\.25\.0[2-5]')) AS im FROM tp GROUP BY 1), cd AS (SELECT doc, bool_or(regexp_matches(text, '\bR\d{{4}}\b')) AS codes FROM rp WHERE regexp_matches(text, '[A-Z]\.\d{{2}}\.\d{{2}}') GROUP BY 1)
SELECT doc, CASE string_split(f, '.')[-1] WHEN '22' THEN 'group' WHEN '01' THEN 'solo' ELSE 'unknown' END AS kind, CASE WHEN st THEN 'standard formula' WHEN im THEN 'internal model' ELSE 'unknown' END AS method, CASE WHEN codes THEN 'codes' ELSE 'labels' END AS mode FROM pf JOIN cd USING (doc)""")
def document_profiles(spark, d):
    x = report(spark, d)
    return inventory.profiles(inventory.template_pages(x), x)


@query(rf"""WITH {_REPORT}, k AS (SELECT doc, page_no, CASE WHEN contains(lower(text), 'annex') THEN 'contents' WHEN regexp_matches(text, '[A-Z]\.\d{{2}}\.\d{{2}}') THEN 'table' ELSE 'narrative' END AS kind FROM rp),
ab AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN 'missing code' ELSE 'picture' END AS anomaly FROM tp WHERE n_chars <= 500 AND doc % 2 = 0), b AS (SELECT doc, count(*) AS anomalies, count(*) FILTER (anomaly = 'missing code') AS blocking FROM ab GROUP BY 1)
SELECT doc, count(*) AS pages, count(*) FILTER (kind = 'narrative') AS narrative_pages, count(*) FILTER (kind = 'table') AS table_pages, count(*) FILTER (kind = 'contents') AS contents_pages, coalesce(any_value(anomalies), 0) AS anomalies, coalesce(any_value(blocking), 0) AS blocking, CASE WHEN coalesce(any_value(blocking), 0) > 0 THEN 'to be checked by hand' ELSE 'ready' END AS conclusion FROM k LEFT JOIN b USING (doc) GROUP BY doc""")
def diagnostic_rollup(spark, d):
    x = report(spark, d)
    kinds = x.select("doc", F.when(F.lower("text").contains("annex"), "contents").when(c("text").rlike(inventory.TEMPLATE), "table").otherwise("narrative").alias("kind"))
    bad = inventory.template_pages(x).where("n_chars <= 500 AND doc % 2 = 0").select("doc", F.when(c("doc") % 3 == 0, "missing code").otherwise("picture").alias("anomaly"))
    return inventory.conclusion(kinds, bad, BLOCKING)


def _contents(spark, d) -> DataFrame:
    """Lines as those of a table of contents: with codes or without, over one line or several, page numbers after dots, and a rest."""
    n, k = c("page_no"), c("doc")
    short = F.trim(F.regexp_replace(F.substring("line", 1, 20), r"\.+", ""))
    code = F.concat(F.lit("B."), (n % 6).cast("string"), F.lit(". "))
    text = F.when(n % 7 == 0, n.cast("string")).when(n % 5 == 1, F.concat(code, short, F.lit(" ..... "), (n + k).cast("string").substr(F.lit(1), F.lit(4)))).when(n % 5 == 2, F.concat(code, short)).when(n % 5 == 4, F.concat(short, F.lit("......"), (n % 90).cast("string"))).otherwise(short)
    return _numbered(spark, d).select("doc", n.alias("line_no"), text.alias("line"))


_ENTRY = r"^(([A-Z](\.\d+)+\.?|[A-Z]\.)\s+)?(.+?)\s*\.{4,}\s*(\d{1,4})\s*$"
_PREFIX = r"^([A-Z](\.\d+)+\.?|[A-Z]\.)\s+(.+)$"


@query(rf"""WITH nl AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
sh AS (SELECT *, trim(regexp_replace(raw[1:20], '\.+', '', 'g')) AS s FROM nl WHERE trim(raw) <> ''),
cl AS (SELECT doc, n, trim(CASE WHEN n % 7 = 0 THEN n::VARCHAR WHEN n % 5 = 1 THEN 'B.' || n % 6 || '. ' || s || ' ..... ' || (n + doc)::VARCHAR[1:4] WHEN n % 5 = 2 THEN 'B.' || n % 6 || '. ' || s WHEN n % 5 = 4 THEN s || '......' || n % 90 ELSE s END) AS line FROM sh),
ce AS (SELECT *, regexp_matches(line, '{_ENTRY}') AS e FROM cl WHERE line <> '' AND NOT regexp_matches(line, '(?i)^(contents|\d+)$')),
cg AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entry FROM ce),
cf AS (SELECT *, min(n) FILTER (NOT e AND regexp_matches(line, '{_PREFIX}')) OVER (PARTITION BY doc, entry) AS first FROM cg)
SELECT doc, entry::BIGINT AS entry, coalesce(max(nullif(regexp_extract(line, '{_ENTRY}', 2), '')) FILTER (e), max(regexp_extract(line, '{_PREFIX}', 1)) FILTER (n = first)) AS section, string_agg(CASE WHEN e THEN regexp_extract(line, '{_ENTRY}', 4) WHEN n = first THEN regexp_extract(line, '{_PREFIX}', 3) ELSE line END, ' ' ORDER BY n) AS title, max(TRY_CAST(regexp_extract(line, '{_ENTRY}', 5) AS INT)) FILTER (e) AS page FROM cf GROUP BY doc, entry""".replace("(n + doc)::VARCHAR[1:4]", "((n + doc)::VARCHAR)[1:4]"))
def contents_entries(spark, d):
    return inventory.contents(_contents(spark, d), ["doc"])


@query(rf"""WITH {_REPORT} SELECT doc, page_no, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT doc, page_no, regexp_extract_all(text, '(?m)^#{{1,3}}\s*([A-Z](\.\d+)+\.?|[A-Z]\.)\s+.+?\s*$', 1)[-1] AS h FROM rp)""")
def page_sections(spark, d):
    return inventory.page_sections(report(spark, d))


@query(rf"""WITH {_REPORT} SELECT doc, arg_min(CASE WHEN regexp_matches(text, '{COVER["year"]}') THEN regexp_extract(text, '{COVER["year"]}', 1) END, page_no) AS year, arg_min(CASE WHEN regexp_matches(text, '{COVER["entity"]}') THEN regexp_extract(text, '{COVER["entity"]}', 1) END, page_no) AS entity FROM rp WHERE page_no <= 3 GROUP BY doc""")
def cover_metadata(spark, d):
    return inventory.cover_facts(report(spark, d), COVER)
