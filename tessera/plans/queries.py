"""The queries of the domain operators and search, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import comparability as cmp
from tessera.operators import documents, indicators, ordering, places, search, warehouse
from tessera.plans.fixtures import COMPANIES_SQL, KPIS_SQL, companies, kpis
from tessera.session import table
from tessera.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}
C, K = f"WITH {COMPANIES_SQL} ", f"WITH {KPIS_SQL} "
CK = f"WITH {COMPANIES_SQL}, {KPIS_SQL} "
c = F.col


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- search -----------------------------------------------------------------------------------------------------------


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("q"))
    return search.dense_topk(q, e.select("vec_id", c("embedding").alias("v")), k)


_DENSE = """s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def vector_topk(spark, d):
    return _dense(spark, d, 5)


@query(f"""WITH {_DENSE}, h AS (SELECT query_id, min(rank) FILTER (a.label = b.label) AS first FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM h""")
def vector_recall_mrr(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _dense(spark, d, 5).join(labels, "vec_id").select("query_id", c("label").alias("item"), "rank")
    golden = labels.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("label").alias("expected"))
    return search.retrieval_quality(found, golden, 5)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("question"))
    return search.bm25(table(spark, d, "documents"), q)


_TOK = "regexp_extract_all(lower(text), '[\\pL\\pN_]+')"
_BM25 = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM df, st),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, round(score, 3) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return search.ranked(_bm25(spark, d).withColumn("score", F.round("score", 3)), ["query_id"], 5, tie="doc_id")


#: Questions are the items of the benchmark that have a vector of their number; a document's vector is the one of its number.
_LISTS = """l AS (SELECT q.vec_id AS query_id, e.vec_id AS item, e.label % 4 AS collection, round(list_sum([z[1]::DOUBLE * z[2]::DOUBLE FOR z IN list_zip(q.embedding, e.embedding)]), 6) AS s FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Every vector for every question, with its score and collection."""
    e = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").select(c("item_id").alias("query_id"))
    q = e.select(c("vec_id").alias("query_id"), c("embedding").alias("q")).join(asked, "query_id")
    pairs = search.met(q, e.select("vec_id", "label", c("embedding").alias("v")), c("query_id") != c("vec_id"))
    return pairs.select("query_id", c("vec_id").alias("item"), (c("label") % 4).cast("long").alias("collection"), F.round(search.dot(c("q"), c("v")), 6).alias("s"))


@query(f"""WITH {_LISTS}, {_BM25}, a AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM l QUALIFY rank <= 20), b AS (SELECT query_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 3) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20),
f AS (SELECT query_id, item, round(sum(w), 9) AS score FROM (SELECT query_id, item, 0.7::DOUBLE / (60 + rank) AS w FROM a UNION ALL SELECT query_id, item, 0.3::DOUBLE / (60 + rank) FROM b) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM f) SELECT query_id, item, score, rank FROM r WHERE rank <= 5""")
def rrf_weighted(spark, d):
    """Vectors weigh 0.7, words 0.3."""
    dense = search.ranked(_lists(spark, d), ["query_id"], 20, tie="item", score="s").select("query_id", "item", "rank", F.lit(0.7).alias("w"))
    words = search.ranked(_bm25(spark, d).withColumn("score", F.round("score", 3)), ["query_id"], 20, tie="doc_id").select("query_id", c("doc_id").alias("item"), "rank", F.lit(0.3).alias("w"))
    return search.ranked(search.reciprocal_rank_fusion(dense.union(words), weight="w"), ["query_id"], 5, tie="item")


_DISJOINT = f"""{_LISTS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s DESC, item) AS rc FROM l),
f AS (SELECT query_id, item, collection, s, round(1.0::DOUBLE / (60 + rc), 9) AS score FROM k WHERE rc <= 10)"""


def _disjoint(spark, d) -> DataFrame:
    return search.ranked(_lists(spark, d), ["query_id", "collection"], 10, tie="item", score="s")


@query(f"WITH {_DISJOINT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM f) SELECT query_id, item, score, rank FROM r WHERE rank <= 8")
def rrf_disjoint(spark, d):
    return search.ranked(search.reciprocal_rank_fusion(_disjoint(spark, d)), ["query_id"], 8, tie="item")


@query(f"WITH {_DISJOINT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, item) AS rank FROM f) SELECT query_id, collection, item, score, rank FROM r WHERE rank <= 3")
def rrf_comparative(spark, d):
    fused = _disjoint(spark, d).groupBy("query_id", "collection", "item").agg(F.round(F.sum(1.0 / (60 + c("rank"))), 9).alias("score"))
    return search.ranked(fused, ["query_id", "collection"], 3, tie="item").select("query_id", "collection", "item", "score", "rank")


@query(f"""WITH {_DISJOINT}, n AS (SELECT query_id, item, round(CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0::DOUBLE ELSE (s - min(s) OVER w)::DOUBLE / (max(s) OVER w - min(s) OVER w) END, 6) AS norm FROM f WINDOW w AS (PARTITION BY query_id, collection)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm DESC, item) AS rank FROM n) SELECT query_id, item, norm, rank FROM r WHERE rank <= 5""")
def baseline_minmax(spark, d):
    """The lists' scores between 0 and 1, then one order over all of them."""
    x = search.min_max(_disjoint(spark, d).select("query_id", "collection", "item", c("s").alias("score")), ["query_id", "collection"])
    return search.ranked(x, ["query_id"], 5, tie="item", score="norm").select("query_id", "item", "norm", "rank")


@query(f"""WITH {_LISTS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS ra FROM l) SELECT query_id, string_agg(format('[Article {{}} - {{}}]\n{{}}\n', doc_id, source, text), '\n' ORDER BY ra) AS context FROM k JOIN documents ON doc_id = item WHERE ra <= 3 GROUP BY 1""")
def context_build(spark, d):
    x = search.ranked(_lists(spark, d), ["query_id"], 3, tie="item", score="s").join(table(spark, d, "documents"), c("item") == c("doc_id"))
    return search.context(x.select("query_id", "rank", c("doc_id").alias("number"), c("source").alias("title"), "text"))


# --- text ---------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(160), ' '), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(c("html")).alias("body"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INT AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(c("text")).alias("words"))


@query("SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'àâäáãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\s+', ' ', 'g'))) AS key FROM documents")
def label_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.label_key(c("text"))).alias("key"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\[Article (\\d+)', 1)) AS cited, starts_with(text, 'The') AND NOT contains(text, '[Article ') AS refusal FROM documents""")
def citations_and_refusals(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", F.size(text.citations(c("text"))).cast("long").alias("cited"), text.is_refusal(c("text"), "The").alias("refusal"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?is)^(.*?)\b(the)\b', '\1\2 (article)') AS t FROM documents) SELECT doc_id, md5(regexp_replace(t, '(?is)^(.*?)\b(of)\b', '\1\2 (preposition)')) AS expanded FROM a""")
def acronym_expand(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.expand_first(c("text"), [("the", "article"), ("of", "preposition")])).alias("expanded"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, line_no::INT AS line_no, CASE WHEN contains(f, ';') OR contains(f, '"') THEN '"' || replace(f, '"', '""') || '"' ELSE f END AS field FROM (SELECT *, CASE WHEN line_no % 5 = 0 THEN '''=' || line WHEN regexp_matches(line, '^[=+\-@\t]') THEN '''' || line ELSE line END AS f FROM l) WHERE trim(line) <> ''""")
def csv_fields(spark, d):
    """Every fifth line starts as a formula would."""
    x = documents.lines(table(spark, d, "documents"))
    return x.select("doc_id", "line_no", text.csv_text(F.when(c("line_no") % 5 == 0, F.concat(F.lit("="), "line")).otherwise(c("line"))).alias("field"))


# --- figures ------------------------------------------------------------------------------------------------------------

_PRINTED = """n AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * 100)::BIGINT AS cents FROM lineitem)"""


@query(f"""WITH {_PRINTED} SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN -(cents // 100)::DOUBLE WHEN 1 THEN (cents // 100)::DOUBLE / 100 WHEN 2 THEN 0.0 ELSE ((cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0'))::DOUBLE END AS value FROM n""")
def number_parse(spark, d):
    x = table(spark, d, "lineitem").withColumn("cents", (c("l_extendedprice") * 100 + 0.5).cast("long"))
    whole = (c("cents") / 100).cast("long")
    grouped = F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" "))
    raw = F.when(c("l_linenumber") % 4 == 0, F.concat(F.lit("("), grouped, F.lit(")"))).when(c("l_linenumber") % 4 == 1, F.concat(whole.cast("string"), F.lit(" %"))).when(c("l_linenumber") % 4 == 2, F.lit("-")).otherwise(F.concat(grouped, F.lit(","), F.lpad((c("cents") % 100).cast("string"), 2, "0")))
    return x.select("l_orderkey", "l_linenumber", numbers.parse_number(raw).alias("value"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN round(p_retailprice / 1000000, 8) WHEN 1 THEN round(p_retailprice / 1000, 8) ELSE round(p_retailprice, 8) END AS scaled FROM part""")
def unit_scale(spark, d):
    unit = F.when(c("p_size") % 3 == 0, "EUR").when(c("p_size") % 3 == 1, "in thousands").otherwise("millions")
    return table(spark, d, "part").select("p_partkey", F.round(c("p_retailprice") / numbers.unit_divisor(unit), 8).alias("scaled"))


# --- warehouse ----------------------------------------------------------------------------------------------------------


@query(K + "SELECT * FROM kpis")
def kpi_long_build(spark, d):
    return kpis(spark, d)


@query(K + "SELECT company_id, kpi_name, year, value FROM kpis WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, kpi_name ORDER BY year DESC) = 1")
def kpi_latest(spark, d):
    return warehouse.latest(kpis(spark, d), ["company_id", "kpi_name"], "year").select("company_id", "kpi_name", "year", "value")


@query(K + "SELECT year, kpi_name, count(value) AS n, round(avg(value::DECIMAL(20,8)), 4)::DOUBLE AS mean, median(value) AS median, min(value) AS least, max(value) AS greatest FROM kpis WHERE kpi_name <> 'ratio_scr' GROUP BY ALL")
def kpi_corpus_stats(spark, d):
    return warehouse.stats(kpis(spark, d).where("kpi_name <> 'ratio_scr'"), ["year", "kpi_name"])


@query(K + "SELECT kpi_name, max(value) FILTER (company_id = 1) AS c1, max(value) FILTER (company_id = 2) AS c2, max(value) FILTER (company_id = 4) AS c4 FROM kpis WHERE year = 1997 GROUP BY 1")
def kpi_compare_pivot(spark, d):
    k = kpis(spark, d).where("year = 1997")
    return k.groupBy("kpi_name").agg(*[F.max(F.when(c("company_id") == i, c("value"))).alias(f"c{i}") for i in (1, 2, 4)])


@query(CK + "SELECT c.company_id, n.kpi_name, k.value, coalesce(k.validated, false) AS validated FROM companies c, (SELECT DISTINCT kpi_name FROM kpis) n LEFT JOIN kpis k ON k.company_id = c.company_id AND k.kpi_name = n.kpi_name AND k.year = 1998")
def kpi_dense_export(spark, d):
    k = kpis(spark, d)
    out = warehouse.dense(companies(spark, d).select("company_id"), k.select("kpi_name").distinct(), k.where("year = 1998").select("company_id", "kpi_name", "value", "validated"), ["company_id", "kpi_name"])
    return out.withColumn("validated", F.coalesce("validated", F.lit(False)))


@query(K + "SELECT kpi_name, max(unit) AS unit, count(DISTINCT unit) AS units, count(DISTINCT company_id) AS companies, count(*) AS n FROM kpis GROUP BY 1")
def kpi_catalogue(spark, d):
    return kpis(spark, d).groupBy("kpi_name").agg(F.max("unit").alias("unit"), F.count_distinct("unit").alias("units"), F.count_distinct("company_id").alias("companies"), F.count("*").alias("n"))


@query(K + "SELECT company_id, count(*) FILTER (value IS NOT NULL) AS extracted, count(*) FILTER (validated) AS validated, 13 * count(DISTINCT year) AS expected, NOT bool_or(validated) AS is_new FROM kpis GROUP BY 1")
def kpi_coverage(spark, d):
    return kpis(spark, d).groupBy("company_id").agg(F.count("value").alias("extracted"), F.count_if("validated").alias("validated"), (13 * F.count_distinct("year")).alias("expected"), (~F.bool_or("validated")).alias("is_new"))


@query(K + "SELECT company_id, year, kpi_name, CASE WHEN year = 1998 AND company_id % 2 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN year = 1998 AND company_id % 2 = 0 THEN 'new' ELSE unit END AS unit, validated FROM kpis WHERE kpi_name = 'own_funds' AND NOT (year = 1998 AND company_id % 4 = 1) UNION ALL SELECT company_id, year, kpi_name, value + 1, 'new', validated FROM kpis WHERE kpi_name = 'own_funds' AND year = 1998 AND company_id % 4 = 1 AND company_id % 2 <> 0")
def upsert_merge(spark, d):
    k = kpis(spark, d).where("kpi_name = 'own_funds'").select("company_id", "year", "kpi_name", "value", "unit", "validated")
    old = k.where("NOT (year = 1998 AND company_id % 4 = 1)")
    new = k.where("year = 1998 AND (company_id % 2 = 0 OR company_id % 4 = 1)").withColumn("value", c("value") + 1).withColumn("unit", F.lit("new"))
    return warehouse.upsert(old, new, ["company_id", "year", "kpi_name"], ["value", "unit"])


@query(K + "SELECT company_id, year, kpi_name, value FROM kpis WHERE NOT (year = 1997 AND company_id % 3 = 0) UNION ALL SELECT company_id, year, 'replaced', 0.0 FROM p WHERE year = 1997 AND company_id % 3 = 0")
def replace_partition(spark, d):
    k = kpis(spark, d).select("company_id", "year", "kpi_name", "value")
    new = k.where("year = 1997 AND company_id % 3 = 0").select("company_id", "year").distinct().select("company_id", "year", F.lit("replaced").alias("kpi_name"), F.lit(0.0).alias("value"))
    return warehouse.replace_partitions(k, new, ["company_id", "year"])


@query("""WITH l AS (SELECT user_id AS c_custkey, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT c_custkey, coalesce(v, c_acctbal) AS value, c_acctbal AS raw_value, v IS NOT NULL AS corrected FROM customer LEFT JOIN l USING (c_custkey)""")
def overlay_corrections(spark, d):
    e = table(spark, d, "events").select(c("user_id").alias("c_custkey"), F.struct("ts", "event_id").alias("ts"), c("value").alias("new_value"))
    return warehouse.overlay(table(spark, d, "customer").select("c_custkey", c("c_acctbal").alias("value")), e, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_missing(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'changed' END AS change FROM orders WHERE o_orderkey % 10 < 2")
def snapshot_changes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    after = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(c("o_orderkey") % 10 == 1, c("o_totalprice") + 1).otherwise(c("o_totalprice")))
    return warehouse.changed(o, after, ["o_orderkey"])
