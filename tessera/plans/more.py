"""Queries of reading, building, labels, layout and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import building, indicators, layout, ordering, reading, search
from tessera.operators import comparability as cmp
from tessera.plans.domain import _MEASURES, ALERTS_SQL, alerts
from tessera.plans.fixtures import NAMES, companies, kpis
from tessera.plans.queries import CK, C, K, c, query
from tessera.session import table


def _sql_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


# --- reading ------------------------------------------------------------------------------------------------------------


def _requests(spark, d) -> DataFrame:
    return companies(spark, d).where("company_id % 10 = 0").select("company_id", F.lit(1997).alias("year"), F.explode(F.array(F.lit("mcr"), F.lit("premiums"))).alias("kpi_name"))


_REQUESTS = "q AS (SELECT company_id, 1997 AS year, unnest(['mcr', 'premiums']) AS kpi_name FROM companies WHERE company_id % 10 = 0)"


@query(f"{CK}, {_REQUESTS} SELECT company_id, year, kpi_name, value, unit, validated FROM q LEFT JOIN kpis USING (company_id, year, kpi_name)")
def kpi_lookup(spark, d):
    return reading.lookup(_requests(spark, d), kpis(spark, d)).select("company_id", "year", "kpi_name", "value", "unit", "validated")


@query(f"{CK}, {_REQUESTS} SELECT company_id, year, kpi_name, value FROM q LEFT JOIN kpis USING (company_id, year, kpi_name)")
def kpi_lookup_strict(spark, d):
    return reading.strict_lookup(_requests(spark, d), kpis(spark, d), companies(spark, d)).select("company_id", "year", "kpi_name", "value")


@query(K + "SELECT company_id, category, kpi_name, value, row_number() OVER (PARTITION BY company_id ORDER BY category, kpi_name) AS place FROM kpis WHERE year = 1997")
def kpis_of_year(spark, d):
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("category", "kpi_name"))
    return kpis(spark, d).where("year = 1997").select("company_id", "category", "kpi_name", "value", place.alias("place"))


@query(K + "SELECT company_id, year, kpi_name, value FROM kpis WHERE category = 'funds'")
def kpis_by_category(spark, d):
    return reading.optional_filter(kpis(spark, d), category="funds").select("company_id", "year", "kpi_name", "value")


@query(K + "SELECT company_id, year, kpi_name, value FROM kpis WHERE NOT validated")
def kpis_not_validated(spark, d):
    return kpis(spark, d).where(~c("validated")).select("company_id", "year", "kpi_name", "value")


@query(K + "SELECT company_id, year, count(value) AS n, coalesce(max(value) FILTER (kpi_name = 'mcr'), -1) AS mcr FROM kpis GROUP BY ALL")
def kpi_map(spark, d):
    entries = F.filter(F.collect_list(F.struct("kpi_name", "value")), lambda x: x["value"].isNotNull())
    m = kpis(spark, d).groupBy("company_id", "year").agg(F.map_from_entries(entries).alias("m"))
    return m.select("company_id", "year", F.size("m").cast("long").alias("n"), F.coalesce(F.try_element_at("m", F.lit("mcr")), F.lit(-1.0)).alias("mcr"))


@query(K + "SELECT company_id, year, kpi_name, value FROM kpis WHERE value IS NOT NULL AND kpi_name NOT IN ('claims', 'premiums')")
def kpis_given(spark, d):
    return kpis(spark, d).where(c("value").isNotNull() & ~c("kpi_name").isin("claims", "premiums")).select("company_id", "year", "kpi_name", "value")


@query(C + "SELECT company_id, activity, model FROM companies WHERE activity = 'life' AND perimeter = 'solo'")
def company_filter(spark, d):
    return reading.optional_filter(companies(spark, d), activity="life", model=None, perimeter="solo").select("company_id", "activity", "model")


@query(C + "SELECT company_id, name FROM companies WHERE contains(lower(name), '0001') AND parent_id IS NULL")
def company_search(spark, d):
    return reading.search_filter(companies(spark, d), " 0001 ", c("parent_id").isNull()).select("company_id", "name")


@query(CK + "SELECT company_id, year, kpi_name, CASE WHEN kpi_name = 'claims' THEN activity IN ('non-life', 'health') ELSE true END AS applicable FROM kpis JOIN companies USING (company_id)")
def kpi_applicable(spark, d):
    rule = reading.applicable(c("kpi_name"), c("activity"), {"claims": ["non-life", "health"]})
    return kpis(spark, d).join(companies(spark, d), "company_id").select("company_id", "year", "kpi_name", rule.alias("applicable"))


@query("SELECT l_orderkey, bool_or(l_linenumber >= 5) AS in_zone, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page FROM lineitem GROUP BY 1")
def page_zone(spark, d):
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("pages"))
    return pages.select("l_orderkey", F.exists("pages", lambda x: x >= 5).alias("in_zone"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"))


@query("SELECT l_orderkey, bool_and(coalesce(n > p, true)) AS rising FROM (SELECT *, lag(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_quantity AS n FROM lineitem)) GROUP BY 1")
def pages_rising(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_quantity"]).alias("v"))
    return listed.select("l_orderkey", text.strictly_rising(c("v")).alias("rising"))


@query(K + "SELECT company_id, year, kpi_name AS kpi, source_page AS line FROM kpis")
def pattern_index(spark, d):
    name = F.concat(F.lit("line_of_"), "kpi_name", F.lit("_"), c("source_page").cast("string"))
    kpi, line = reading.numbered_pattern(c("stored"), "line_of_")
    return kpis(spark, d).select("company_id", "year", name.alias("stored")).where(c("stored").like("line_of_%")).select("company_id", "year", kpi.alias("kpi"), line.alias("line"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '% BRASS' THEN p_type[:-7] ELSE p_type END AS short FROM part")
def type_without_group(spark, d):
    return table(spark, d, "part").select("p_partkey", reading.without_suffix(c("p_type"), F.lit("BRASS")).alias("short"))


@query(CK + "SELECT company_id, year, CASE WHEN perimeter = 'group' AND kpi_name = 'mcr' THEN 'minimum group requirement' ELSE kpi_name END AS label, CASE category WHEN 'funds' THEN 'capital' WHEN 'activity' THEN CASE kpi_name WHEN 'claims' THEN 'losses' ELSE 'business' END ELSE category END AS shown, CASE WHEN value IS NULL THEN 'missing' WHEN validated THEN 'verified' ELSE 'extracted' END AS confidence FROM kpis JOIN companies USING (company_id)")
def display_labels(spark, d):
    label = F.when((c("perimeter") == "group") & (c("kpi_name") == "mcr"), "minimum group requirement").otherwise(c("kpi_name"))
    shown = F.coalesce(F.create_map(F.lit("claims"), F.lit("losses"))[c("kpi_name")], F.create_map(F.lit("funds"), F.lit("capital"), F.lit("activity"), F.lit("business"))[c("category")], c("category"))
    return kpis(spark, d).join(companies(spark, d), "company_id").select("company_id", "year", label.alias("label"), shown.alias("shown"), reading.confidence(c("value"), c("validated")).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'plain' WHEN starts_with(p_type, 'S') THEN 'small' ELSE 'other' END AS family FROM part")
def family_by_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", reading.by_prefix(c("p_type"), [("STANDARD", "plain"), ("S", "small")], "other").alias("family"))


@query(f"{K}, o AS (SELECT unnest({list(NAMES)}) AS kpi_name, unnest(range({len(NAMES)})) AS o) SELECT category, kpi_name, n, upper(category[1]) || lpad((row_number() OVER (PARTITION BY category ORDER BY o))::VARCHAR, 2, '0') AS code FROM (SELECT category, kpi_name, count(*) AS n FROM kpis GROUP BY ALL) JOIN o USING (kpi_name)")
def display_codes(spark, d):
    """Codes of the indicators that there are, in declared order."""
    declared = F.array_position(F.array(*[F.lit(n) for n in NAMES]), c("kpi_name")).alias("ordinal")
    rows = kpis(spark, d).groupBy("category", "kpi_name").agg(F.count("*").alias("n")).select("category", "kpi_name", "n", declared)
    return reading.display_codes(rows).select("category", "kpi_name", "n", "code")


@query(K + "SELECT o_custkey AS company_id, count(*) AS n FROM orders JOIN p ON o_custkey = company_id AND year(o_orderdate) = year WHERE abs(o_totalprice / 1000 - own_funds) > 0.01 OR mcr IS NULL GROUP BY 1")
def residual_join(spark, d):
    w = indicators.wide(kpis(spark, d), ["own_funds", "mcr"])
    o = table(spark, d, "orders").select(c("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.join(w, ["company_id", "year"]).where((F.abs(c("o_totalprice") / 1000 - c("own_funds")) > 0.01) | c("mcr").isNull()).groupBy("company_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN n = 1 THEN v END AS l_partkey, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def unique_match(spark, d):
    left = table(spark, d, "orders").select("o_orderkey")
    return reading.unique_match(left, table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_partkey"), ["o_orderkey"], "l_partkey")


@query(C + "SELECT a.parent_id, p.name AS parent, count(*) AS n, min(a.company_id) AS first_child, max(a.company_id) AS last_child FROM companies a JOIN companies p ON p.company_id = a.parent_id GROUP BY ALL")
def subsidiary_tree(spark, d):
    return reading.subsidiaries(companies(spark, d))


@query("WITH f AS (SELECT md5(text) AS h, min(doc_id) AS target FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id AS ref, coalesce(target, doc_id) AS canonical FROM documents LEFT JOIN f ON md5(text) = h")
def canonical_refs(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("ref"), F.md5("text").alias("h"))
    first = docs.where("h IS NOT NULL").groupBy("h").agg(F.min("ref").alias("target"))
    return reading.canonical(docs, docs.join(first, "h").where("ref <> target").select("ref", "target")).select("ref", "canonical")


@query("SELECT p_brand, string_agg(p_type, ' | ' ORDER BY o) AS texts FROM (SELECT p_brand, p_type, min(p_partkey) AS o FROM part GROUP BY ALL) GROUP BY 1")
def formula_texts(spark, d):
    return reading.first_seen_texts(table(spark, d, "part"), "p_brand", "p_type", "p_partkey")


@query("SELECT l_suppkey, sum(q)::DOUBLE AS total FROM (SELECT l_suppkey, l_partkey, arg_min(l_quantity, (l_linenumber, l_orderkey, l_quantity)) AS q FROM lineitem GROUP BY ALL) GROUP BY 1")
def cumulative_variants(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_orderkey", "l_quantity"))["l_quantity"].alias("q"))
    return first.groupBy("l_suppkey").agg(F.sum("q").cast("double").alias("total"))


@query("""WITH i AS (SELECT DISTINCT l_linestatus || ' ' || l_returnflag AS issue, l_suppkey AS file FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY file) AS r FROM i)
SELECT issue, count(*) AS files, string_agg(file::VARCHAR, ',' ORDER BY file::VARCHAR) FILTER (r <= 3) AS examples FROM r GROUP BY 1""")
def issue_groups(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("issue"), c("l_suppkey").alias("file"))
    return reading.issue_groups(rows, "issue", "file")


@query(C + "SELECT g AS group_name, n, row_number() OVER (ORDER BY n DESC, g) AS place FROM (SELECT coalesce(CASE WHEN parent_id IS NOT NULL THEN 'of ' || activity END, 'independent') AS g, count(*) AS n FROM companies GROUP BY 1)")
def group_counts(spark, d):
    rows = companies(spark, d).withColumn("belongs", F.when(c("parent_id").isNotNull(), F.concat(F.lit("of "), "activity")))
    return reading.with_independents(rows, "belongs", "independent")


_ALERTS = f"{_MEASURES}, a AS ({ALERTS_SQL})"


@query(f"{K}, {_ALERTS} SELECT level, count(*) AS n FROM a GROUP BY 1")
def alert_levels(spark, d):
    return alerts(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query(f"{K}, {_ALERTS} SELECT company_id, min(level) AS level, arg_min(rule, (level, rule)) AS rule, count(*) AS n, count(*) FILTER (level = 1) AS dangers FROM a GROUP BY 1")
def alert_order(spark, d):
    return reading.worst_first(alerts(spark, d))


@query(K + "SELECT year, 'up' AS direction, company_id, mcr, row_number() OVER (PARTITION BY year ORDER BY mcr ASC NULLS FIRST, company_id) AS place FROM p QUALIFY place <= 20 UNION ALL SELECT year, 'down', company_id, mcr, row_number() OVER (PARTITION BY year ORDER BY mcr DESC NULLS LAST, company_id) AS place FROM p QUALIFY place <= 20")
def order_nulls(spark, d):
    """The first twenty of each year either way; Spark keeps twenty a partition before the shuffle."""
    w = indicators.wide(kpis(spark, d), ["mcr"])
    one = lambda up: w.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(reading.nulls_by_direction(c("mcr"), up), "company_id"))).where("place <= 20").select("year", F.lit("up" if up else "down").alias("direction"), "company_id", "mcr", "place")
    return one(True).unionByName(one(False))


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS a, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS b FROM documents WHERE text IS NOT NULL) WHERE a <= 10 OR b <= 10")
def shortest_longest(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.char_length("text").cast("long").alias("n"))
    return docs.orderBy("n", "doc_id").limit(10).union(docs.orderBy(F.desc("n"), "doc_id").limit(10)).distinct()


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM conversations")
def rerank_stable(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("score"))
    return search.ranked(rows, ["conv_id"], 1 << 30, tie="turn").select("conv_id", "turn", c("rank").alias("place"))


_NAMED = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN replace(p_name, 'a', 'À') WHEN 3 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END"


@query(f"SELECT p_partkey, name, row_number() OVER (ORDER BY name COLLATE fr, p_partkey) AS place FROM (SELECT p_partkey, {_NAMED} AS name FROM part)")
def collated_order(spark, d):
    """Names in the order of the locale, with capitals and accents, ties by key."""
    n, k = c("p_name"), c("p_partkey") % 5
    name = F.when(k == 0, F.upper(n)).when(k == 1, F.replace(n, F.lit("e"), F.lit("é"))).when(k == 2, F.replace(n, F.lit("a"), F.lit("À"))).when(k == 3, F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 30))).otherwise(n)
    ranked = ordering.global_rank(table(spark, d, "part").select("p_partkey", name.alias("name"), F.collate(name, "fr").alias("k")), "k", "p_partkey")
    return ranked.select("p_partkey", "name", "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 10 AS number FROM lineitem")
def column_codes(spark, d):
    code = F.concat(F.lit("C"), F.lpad((c("l_linenumber") * 10).cast("string"), 4, "0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.regexp_extract(code, r"^C(\d+)$", 1).cast("int").alias("number"))


@query(K + "SELECT company_id, source_page FROM kpis WHERE kpi_name = 'own_funds' UNION ALL SELECT company_id, source_page + 1 FROM kpis WHERE kpi_name LIKE 'tier%'")
def kpi_pages(spark, d):
    k = kpis(spark, d)
    own = k.where("kpi_name = 'own_funds'").select("company_id", "source_page")
    return own.unionByName(k.where(c("kpi_name").startswith("tier")).select("company_id", (c("source_page") + 1).alias("source_page")))


@query("SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only FROM (SELECT k, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT DISTINCT l_partkey AS k, 1 AS s FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT l_partkey, 2 FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1)")
def ref_sets(spark, d):
    li = table(spark, d, "lineitem")
    a, b = li.where("l_returnflag = 'R'").select("l_partkey"), li.where("l_linestatus = 'O'").select("l_partkey")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(a.intersect(b), "both").join(one(a.exceptAll(b).distinct().join(b, "l_partkey", "left_anti"), "first_only")).join(one(b.distinct().join(a, "l_partkey", "left_anti"), "second_only"))


@query("SELECT count(*) AS n, count(DISTINCT code) AS codes, count(*) = count(DISTINCT code) AS unambiguous FROM (SELECT DISTINCT p_size AS code, 'size' AS dim FROM part UNION ALL SELECT DISTINCT p_partkey + 100000000, 'key' FROM part)")
def code_overlap(spark, d):
    p = table(spark, d, "part")
    codes = p.select(c("p_size").cast("long").alias("code")).distinct().union(p.select((c("p_partkey") + 100000000).alias("code")).distinct())
    return codes.agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes")).withColumn("unambiguous", c("n") == c("codes"))


@query("WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS signature FROM lineitem GROUP BY 1) SELECT l_orderkey, signature, count(*) OVER (PARTITION BY signature) - 1 AS partners FROM s QUALIFY partners > 0")
def mergeable_sheets(spark, d):
    return reading.mergeable(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


# --- text and figures ---------------------------------------------------------------------------------------------------

_ART = "a AS (SELECT item_id % 10 AS id, string_agg('Article ' || item_id || ' Title ' || item_id || chr(10) || replace(text, chr(10), ' '), chr(10) ORDER BY item_id) AS text FROM benchmark GROUP BY 1)"


def _articles(spark, d) -> DataFrame:
    one = F.concat(F.lit("Article "), c("item_id").cast("string"), F.lit(" Title "), c("item_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = table(spark, d, "benchmark").select((c("item_id") % 10).alias("id"), F.struct("item_id", one.alias("t")).alias("s"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), "\n").alias("text"))


@query("SELECT item_id % 10 AS id, item_id::VARCHAR AS number, 'Title ' || item_id AS title, trim(replace(text, chr(10), ' ')) AS body FROM benchmark")
def article_segments(spark, d):
    return layout.articles(_articles(spark, d), "Article ").select("id", "number", "title", F.trim("body").alias("body"))


@query("SELECT doc_id, regexp_matches(text, '(?i)page [0-9]+ of [0-9]+|all rights') AS footer, contains(text, 'Official Journal') AS journal FROM documents WHERE text IS NOT NULL")
def footer_flags(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", c("text").rlike("(?i)page [0-9]+ of [0-9]+|all rights").alias("footer"), c("text").contains("Official Journal").alias("journal"))


@query("SELECT item_id, NOT (item_id % 3 = 0) AS enough, CASE WHEN item_id % 3 = 0 THEN 'ask ' || item_id END AS question FROM benchmark")
def judge_replies(spark, d):
    reply = F.when(c("item_id") % 3 == 0, F.concat(F.lit("No : ask "), c("item_id").cast("string"))).otherwise("Yes")
    enough, question = text.verdict(reply, "yes", "no")
    return table(spark, d, "benchmark").select("item_id", enough.alias("enough"), question.alias("question"))


@query("SELECT p_partkey, contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(w[1:2], ' ') || ' ') AS own, contains(' ' || array_to_string(w, ' ') || ' ', ' small brass ') AS brass FROM (SELECT p_partkey, list_filter(string_split_regex(replace(lower(p_type), '-', ' '), '\\s+'), lambda x: x <> '' AND x <> 'plated') AS w FROM part)")
def name_tokens(spark, d):
    p = table(spark, d, "part").select("p_partkey", text.name_tokens(c("p_type"), ["plated"]).alias("w"))
    return p.select("p_partkey", text.holds_tokens(c("w"), F.slice("w", 1, 2)).alias("own"), text.holds_tokens(c("w"), F.array(F.lit("small"), F.lit("brass"))).alias("brass"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'B.' || l_linenumber AS code, 'B' AS letter FROM lineitem")
def section_codes(spark, d):
    path = F.array(F.lit("A. Business"), F.concat(F.lit("B."), c("l_linenumber").cast("string"), F.lit(" Risk")), F.lit("Detail of it"))
    code, letter = text.section_code(path)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"), letter.alias("letter"))


def _marked() -> Column:
    return F.concat(F.lit("Intro.\n\nOf "), c("item_id").cast("string"), F.lit(" [TABLE: #/t/"), c("item_id").cast("string"), F.lit("] then a picture [IMAGE: #/p/1]\n[LEGEND: x]"))


@query("""SELECT item_id AS id, 0 AS place, 'TABLE' AS kind, '#/t/' || item_id AS ref, 'Of ' || item_id AS paragraph FROM benchmark UNION ALL SELECT item_id, 1, 'IMAGE', '#/p/1', 'then a picture' FROM benchmark""")
def marker_paragraphs(spark, d):
    return layout.before_markers(table(spark, d, "benchmark").select(c("item_id").alias("id"), _marked().alias("text")))


@query("SELECT item_id, 'Intro.' || chr(10) || chr(10) || 'Of ' || item_id || ' [TABLE: #/t/' || item_id || '] then a picture' AS text FROM benchmark")
def trailing_markers(spark, d):
    return table(spark, d, "benchmark").select("item_id", layout.without_last_markers(_marked()).alias("text"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, contains(lower(p_name), lower('A')) AS holds, lower(p_brand) AS fenced, 'Of ' || p_brand AS label FROM part")
def slugs_and_labels(spark, d):
    fenced = text.without_fence(F.concat(F.lit("```json\n"), F.lower("p_brand"), F.lit("\n```")))
    return table(spark, d, "part").select("p_partkey", text.slug(c("p_name")).alias("slug"), text.holds_label(c("p_name"), F.lit("A")).alias("holds"), fenced.alias("fenced"), text.clean_label(F.concat(F.lit("R0210 -  Of   "), "p_brand")).alias("label"))


@query("SELECT o_orderkey, floor(o_totalprice) + 0.5 AS typed, CASE WHEN floor(o_totalprice) >= 100 THEN floor(o_totalprice)::BIGINT END AS scanned, true AS refused FROM orders")
def typed_figures(spark, d):
    whole = F.floor("o_totalprice")
    shown = F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", numbers.user_number(F.concat(F.lit(" "), shown, F.lit(",5"))).alias("typed"), numbers.scanned_integer(shown).alias("scanned"), numbers.user_number(F.concat(shown, F.lit(",5,1"))).isNull().alias("refused"))


@query("SELECT s_suppkey, CASE WHEN v >= 1000 THEN (v // 1000)::VARCHAR || ' ' || lpad((v % 1000)::VARCHAR, 3, '0') ELSE v::VARCHAR END || '|' || CASE WHEN v >= 1000 THEN v::VARCHAR || '|' ELSE '' END || v::VARCHAR || ',000' AS forms, CASE WHEN v >= 1000 THEN (v // 1000)::VARCHAR || ' ' || lpad((v % 1000)::VARCHAR, 3, '0') ELSE v::VARCHAR END || CASE WHEN s_suppkey % 2 = 0 THEN ' K' ELSE ',0 MEUR' END AS shown, '+' || v::VARCHAR || '.0 pts' AS change FROM (SELECT s_suppkey, s_suppkey % 9000 AS v FROM supplier)")
def figure_forms(spark, d):
    v = (c("s_suppkey") % 9000).cast("double")
    even = c("s_suppkey") % 2 == 0
    shown = numbers.with_unit(v, F.lit("MEUR"), F.when(even, v), F.lit("K"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(numbers.printed_forms(v), "|").alias("forms"), shown.alias("shown"), numbers.signed(v, "pts").alias("change"))


# --- on the page --------------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT DISTINCT l_orderkey AS page, l_linenumber * 20.0 + l_quantity AS x0, l_linenumber * 20.0 + l_quantity + 12 AS x1, l_linenumber::VARCHAR AS text FROM lineitem)"


def _words(spark, d) -> DataFrame:
    x = c("l_linenumber") * 20.0 + c("l_quantity")
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("page"), x.alias("x0"), (x + 12).alias("x1"), c("l_linenumber").cast("string").alias("text")).distinct()


@query(f"""WITH {_WORDS}, n AS (SELECT *, coalesce(x0 - lag(x1) OVER o > 5, true) AS new FROM w WINDOW o AS (PARTITION BY page ORDER BY x0, x1, text)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY page ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT page, string_agg(text, '' ORDER BY x0, x1, text) AS text, (min(x0) + max(x1)) / 2 AS centre FROM r GROUP BY page, run""")
def fragment_merge(spark, d):
    return layout.merged_fragments(_words(spark, d), ["page"], 5.0)


_PLACED = "n AS (SELECT DISTINCT l_orderkey AS page, l_quantity AS cx, l_linenumber * 9.0 AS cy, l_partkey AS value FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS page, 'k' || l_linenumber AS code, l_quantity - 3 AS ax, l_linenumber * 9.0 AS ay FROM lineitem)"


def _placed(spark, d) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    numbers_ = li.select(c("l_orderkey").alias("page"), c("l_quantity").alias("cx"), (c("l_linenumber") * 9.0).alias("cy"), c("l_partkey").alias("value")).distinct()
    codes = li.select(c("l_orderkey").alias("page"), F.concat(F.lit("k"), c("l_linenumber").cast("string")).alias("code"), (c("l_quantity") - 3).alias("cx"), (c("l_linenumber") * 9.0).alias("cy")).distinct()
    return codes, numbers_


@query(f"WITH {_PLACED} SELECT page, code, ax, ay, arg_min(value, (cx, cy, value)) AS value FROM a JOIN n USING (page) WHERE abs(cy - ay) <= 15 AND cx > ax GROUP BY ALL")
def number_right(spark, d):
    codes, figures = _placed(spark, d)
    return layout.nearest_right(codes, figures, ["page"], 15.0)


@query(f"WITH {_PLACED} SELECT page, code AS label, ax, ay, arg_min(value, ((cy - ay) * (cy - ay) + (cx - ax) * (cx - ax), value)) AS value FROM a JOIN n USING (page) WHERE cy > ay AND cy - ay <= 30 AND abs(cx - ax) <= 30 GROUP BY ALL")
def number_below(spark, d):
    codes, figures = _placed(spark, d)
    return layout.nearest_below(codes.withColumnRenamed("code", "label"), figures, ["page"], 30.0)


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS value, l_orderkey % 2000 AS pos FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey AS page, l_linenumber AS anchor, l_orderkey % 2000 AS p FROM lineitem WHERE l_returnflag = 'A')
SELECT page, anchor, count(DISTINCT (value, pos)) AS hits FROM v JOIN a USING (page) WHERE abs(pos - p) <= 40 GROUP BY ALL""")
def near_anchor(spark, d):
    li = table(spark, d, "lineitem").withColumn("pos", c("l_orderkey") % 2000)
    values = li.where("l_returnflag = 'R'").select(c("l_suppkey").alias("page"), c("l_partkey").alias("value"), "pos").distinct()
    anchors = li.where("l_returnflag = 'A'").select(c("l_suppkey").alias("page"), c("l_linenumber").alias("anchor"), "pos").distinct()
    return layout.within_window(values, anchors, ["page"], 40)


# --- building -----------------------------------------------------------------------------------------------------------


def _tier_components(k: DataFrame) -> DataFrame:
    return k.where(c("kpi_name").startswith("tier") & c("value").isNotNull()).select("company_id", "year", F.lit("own_funds").alias("kpi_name"), c("kpi_name").alias("label"), c("value").alias("component_value"))


_GATE = "t AS (SELECT company_id, year, sum(value::DECIMAL(38,8))::DOUBLE AS s, count(*) AS n FROM kpis WHERE kpi_name LIKE 'tier%' AND value IS NOT NULL GROUP BY ALL), o AS (SELECT company_id, year, n, round(s, 6) AS recomposed, CASE WHEN own_funds IS NULL THEN 'no stored value' WHEN abs(s - own_funds) <= greatest(abs(own_funds) * 0.5 / 100, 0.5) THEN 'inserted' ELSE 'gap' END AS outcome FROM t JOIN p USING (company_id, year))"


@query(f"{K}, {_GATE} SELECT company_id, year, 'own_funds' AS kpi_name, n, recomposed, outcome FROM o")
def gated_components(spark, d):
    k = kpis(spark, d)
    return building.gated_components(_tier_components(k), k.where("kpi_name = 'own_funds'"), 0.5, 0.5)


@query(f"{K}, {_GATE} SELECT company_id, year, kpi_name AS label, value AS component_value, row_number() OVER (PARTITION BY company_id, year ORDER BY kpi_name) AS component_index FROM kpis JOIN o USING (company_id, year) WHERE outcome = 'inserted' AND kpi_name LIKE 'tier%' AND value IS NOT NULL")
def inserted_components(spark, d):
    k = kpis(spark, d)
    parts = _tier_components(k)
    found = building.inserted_components(parts, building.gated_components(parts, k.where("kpi_name = 'own_funds'"), 0.5, 0.5))
    return found.select("company_id", "year", "label", "component_value", "component_index")


@query(K + "SELECT company_id, year, 'provisions' AS kpi_name, best_estimate + risk_margin AS value FROM p")
def derived_provisions(spark, d):
    return building.derived_sum(kpis(spark, d), ["best_estimate", "risk_margin"], "provisions")


@query(K + "SELECT company_id, year, 'technical_provisions' AS kpi_name, i AS component_index, CASE i WHEN 1 THEN 'best_estimate' ELSE 'risk_margin' END AS label, CASE i WHEN 1 THEN best_estimate ELSE risk_margin END AS component_value FROM p, (VALUES (1), (2)) v(i) WHERE abs(best_estimate + risk_margin - technical_provisions) <= 0.5")
def provisions_pair(spark, d):
    return building.pair_components(kpis(spark, d), ["best_estimate", "risk_margin"], "technical_provisions", 0.5)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, 'net' AS kpi_name, coalesce(max(v) FILTER (l_linenumber = 2), max(v) FILTER (l_linenumber = 1), CASE WHEN count(*) = 1 THEN max(v) END) AS value FROM x GROUP BY 1""")
def label_fallback(spark, d):
    cells = table(spark, d, "lineitem").groupBy("l_orderkey", F.concat(F.lit("C"), c("l_linenumber").cast("string")).alias("column")).agg(F.max("l_quantity").cast("double").alias("value")).withColumn("label", F.lit(" Net  AMOUNT "))
    labels = spark.createDataFrame([("net", "Net amount")], "kpi_name string, expected string")
    return building.label_fallback(cells, labels, ["l_orderkey"], ["C2", "C1"])


@query(f"""{K}, a AS (SELECT company_id, year, own_funds AS a FROM p WHERE own_funds IS NOT NULL), b AS (SELECT company_id, year, tier1 + tier1_restricted + tier2 + tier3 AS b FROM p WHERE company_id % 4 <> 0)
SELECT company_id, year, a, round(b, 6) AS b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(abs(a - b) / greatest(abs(a), abs(b), 1) * 100, 6) END AS gap, CASE WHEN a IS NULL OR b IS NULL THEN 'one source' WHEN round(abs(a - b) / greatest(abs(a), abs(b), 1) * 100, 6) <= 2 THEN 'agree' ELSE 'differ' END AS state FROM a FULL JOIN b USING (company_id, year)""")
def cross_source(spark, d):
    w = indicators.wide(kpis(spark, d), ["own_funds", "tier1", "tier1_restricted", "tier2", "tier3"])
    b = w.where("company_id % 4 <> 0").select("company_id", "year", (c("tier1") + c("tier1_restricted") + c("tier2") + c("tier3")).alias("value"))
    a = w.where("own_funds IS NOT NULL").select("company_id", "year", c("own_funds").alias("value"))
    return building.cross_source(a, b, ["company_id", "year"], 2.0).withColumn("b", F.round("b", 6))


@query(K + "SELECT company_id, year, 'own_funds' AS kpi_name, round(sum((CASE WHEN kpi_name = 'tier3' AND abs(value) <= 100 THEN -value ELSE value END)::DECIMAL(38,8))::DOUBLE, 6) AS value, count(*) FILTER (kpi_name = 'tier3' AND abs(value) <= 100) AS turned FROM kpis WHERE kpi_name LIKE 'tier%' AND value IS NOT NULL GROUP BY ALL")
def sign_corrected(spark, d):
    return building.sign_corrected(_tier_components(kpis(spark, d)), "tier3", 100.0)


@query(K + "SELECT company_id, year, count(value) AS n, round(count(value) / 13, 4) AS coverage, round(sum(round(CASE WHEN unit = 'pct' THEN value WHEN company_id % 9 = 0 THEN value / 1000000 ELSE value / 1000 END, 8)::DECIMAL(38,8))::DOUBLE, 6) AS total FROM kpis GROUP BY ALL")
def entity_values(spark, d):
    entities = companies(spark, d).where("company_id % 9 = 0").select("company_id", F.lit(1e6).alias("divisor"))
    return building.entity_values(kpis(spark, d), entities, 13)


@query(K + "SELECT company_id, year, 'ratio_scr' AS kpi_name, 150.0 + company_id % 3 AS expected, value, 'annex' AS origin, abs(value - (150.0 + company_id % 3)) <= 1.0 AS passed FROM kpis WHERE kpi_name = 'ratio_scr' AND company_id % 6 = 0")
def registry_check(spark, d):
    r = companies(spark, d).where("company_id % 6 = 0").select("company_id", F.lit("ratio_scr").alias("kpi_name"), (c("company_id") % 3 + 150.0).alias("expected"), F.lit("annex").alias("origin"))
    return building.registry_check(kpis(spark, d), r, 1.0)


@query(K + "SELECT company_id, year, mcr * 100 / own_funds AS recomputed, mcr_pct, abs(mcr * 100 / own_funds - mcr_pct) <= 1 AS passed, origin FROM (SELECT *, CASE WHEN company_id % 5 = 0 THEN round(mcr * 100 / own_funds) ELSE 20.0::DOUBLE END AS mcr_pct, CASE WHEN company_id % 5 = 0 THEN 'registry' ELSE 'stored' END AS origin FROM p) WHERE mcr IS NOT NULL AND own_funds > 0")
def ratio_mcr_check(spark, d):
    w = indicators.wide(kpis(spark, d), ["mcr", "own_funds"]).where("mcr IS NOT NULL AND own_funds > 0").withColumn("recomputed", c("mcr") * 100 / c("own_funds"))
    registry = w.where("company_id % 5 = 0").select("company_id", "year", F.round("recomputed").alias("registered"))
    j = w.join(registry, ["company_id", "year"], "left").withColumn("mcr_pct", F.coalesce("registered", F.lit(20.0)))
    return j.select("company_id", "year", "recomputed", "mcr_pct", (F.abs(c("recomputed") - c("mcr_pct")) <= 1).alias("passed"), F.when(c("registered").isNotNull(), "registry").otherwise("stored").alias("origin"))


_PRINTED = """m AS (SELECT DISTINCT l_orderkey, l_quantity::DOUBLE AS amount, 0 AS decimals FROM lineitem), t AS (SELECT DISTINCT l_orderkey, 'n' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 1000.0 ELSE l_quantity::DOUBLE END AS target FROM lineitem),
f AS (SELECT t.l_orderkey, name, o, s, bool_or(abs(amount - abs(target) * s) <= 0.5 * pow(10.0, -decimals) + 1e-6 * greatest(abs(target) * s, 1.0)) AS found FROM t JOIN (VALUES (0, 1.0::DOUBLE), (1, 1000.0::DOUBLE)) v(o, s) ON true JOIN m USING (l_orderkey) GROUP BY ALL),
h AS (SELECT l_orderkey, o, s, count(*) FILTER (found) AS hits FROM f GROUP BY ALL), b AS (SELECT l_orderkey, arg_min(s, (-hits, o)) AS scale, max(hits) AS hits FROM h GROUP BY 1)"""


@query(f"WITH {_PRINTED} SELECT f.l_orderkey, name, scale, hits, found FROM f JOIN b ON f.l_orderkey = b.l_orderkey AND f.s = b.scale")
def printed_presence(spark, d):
    li = table(spark, d, "lineitem")
    q = c("l_quantity").cast("double")
    amounts = li.select("l_orderkey", q.alias("amount"), F.lit(0).alias("decimals")).distinct()
    one = li.select("l_orderkey", F.concat(F.lit("n"), c("l_linenumber").cast("string")).alias("name"), F.when(c("l_linenumber") % 2 == 0, q / 1000.0).otherwise(q).alias("target")).distinct()
    return building.printed_presence(one, amounts, ["l_orderkey"], [1.0, 1000.0])


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, sum(v) FILTER (l_linenumber <= 2) AS total, count(*) FILTER (l_linenumber <= 2) AS n FROM g GROUP BY 1 HAVING n > 0),
c AS (SELECT g.*, total, n FROM g JOIN s USING (l_orderkey) WHERE v > 0 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.l_orderkey = g.l_orderkey AND b.l_linenumber <= 2 AND abs(b.v - g.v) <= 0.5)),
h AS (SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, CASE WHEN abs(a.total - a.v - b.v) <= 0.5 * (a.n + 2) THEN 1 ELSE -1 END AS z FROM c a JOIN c b USING (l_orderkey) WHERE abs(a.total - a.v - b.v) <= 0.5 * (a.n + 2) OR abs(a.total - a.v + b.v) <= 0.5 * (a.n + 2))
SELECT s.l_orderkey, count(x) > 0 AS holds, arg_min(x, (x, y, z)) AS share_pos, arg_min(y, (x, y, z)) AS net_pos, arg_min(z, (x, y, z)) AS sign FROM s LEFT JOIN h USING (l_orderkey) GROUP BY 1""")
def table_identity(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", c("l_linenumber").alias("pos")).agg(F.max("l_quantity").cast("double").alias("value"))
    amounts = g.select("l_orderkey", "pos", c("value").alias("amount"), F.lit(0).alias("decimals"))
    return building.table_identity(amounts, g.where("pos <= 2"), ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'non-life' WHEN 2 THEN 'life' WHEN 3 THEN 'non-life' WHEN 4 THEN 'life' END AS class FROM lineitem")
def component_classes(spark, d):
    n = c("l_linenumber")
    code = F.when(n == 1, "R0210").when(n == 2, "R1510").otherwise("R9")
    label = F.when(n == 3, "Gross Non-Life").when(n == 4, "Life, gross").otherwise("Gross")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", building.component_class(code, label, "non-life", "life", {"R0210": "non-life", "R1510": "life"}).alias("class"))


_MODULES = ["tier1", "mcr", "premiums", "claims"]
_SUM = " + ".join(f"coalesce(floor({m} * 1e8::DOUBLE + 0.5)::HUGEINT, 0)" for m in _MODULES)
_REST = "floor(scr_total * 1e8::DOUBLE + 0.5)::HUGEINT - s - floor(-tier3 * 1e8::DOUBLE + 0.5)::HUGEINT - floor(risk_margin * 1e8::DOUBLE + 0.5)::HUGEINT"
_EXACT = lambda a, b: f"(CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END) * ((abs({a}) * 2000 + {b}) // (2 * {b})) / 10::DOUBLE"


@query(f"{K}, m AS (SELECT *, {_SUM} AS s, {' + '.join(f'({m} IS NOT NULL)::INT' for m in _MODULES)} AS n, floor(scr_total * 1e8::DOUBLE + 0.5)::HUGEINT AS t FROM p) SELECT company_id, year, n, CASE WHEN s > 0 THEN {_EXACT('floor(tier3 * 1e8::DOUBLE + 0.5)::HUGEINT', 's')} END AS diversification, CASE WHEN s > 0 AND n >= 4 AND t <> 0 THEN {_EXACT(_REST, 't')} END AS adjustments, CASE WHEN company_id % 2 = 0 THEN 'standard formula' ELSE 'internal model' END AS base FROM m")
def module_ratios(spark, d):
    k = kpis(spark, d).withColumn("value", F.when(c("kpi_name") == "tier3", -c("value")).otherwise(c("value")))
    base = F.when(c("company_id") % 2 == 0, "standard formula").otherwise("internal model")
    return indicators.module_ratios(k, _MODULES, "tier3", "risk_margin", "scr_total").withColumn("base", base)


# --- comparison ---------------------------------------------------------------------------------------------------------


@query(CK + "SELECT company_id, year, kpi_name, CASE WHEN kpi_name = 'claims' THEN CASE activity WHEN 'health' THEN 'non-life' WHEN 'composite' THEN 'mixed' ELSE activity END ELSE activity END AS axis_value FROM kpis JOIN companies USING (company_id) WHERE category = 'activity'")
def loss_classes(spark, d):
    axis = cmp.loss_class(c("kpi_name"), F.lit("activity"), c("activity"), {"health": "non-life", "composite": "mixed"})
    return kpis(spark, d).where("category = 'activity'").join(companies(spark, d), "company_id").select("company_id", "year", "kpi_name", axis.alias("axis_value"))


def _selections(spark, d) -> DataFrame:
    return companies(spark, d).withColumn("selection", c("company_id") % 400).withColumn("peer_group", cmp.group_key())


_SEL = "s AS (SELECT company_id % 400 AS selection, concat_ws(' · ', activity, model, perimeter) AS peer_group, * EXCLUDE (selection) FROM companies)"


@query(f"{C}, {_SEL} SELECT selection, CASE WHEN count(DISTINCT peer_group) = 1 THEN min(peer_group) END AS common FROM s GROUP BY 1")
def common_group(spark, d):
    return cmp.common_group(_selections(spark, d))


@query(f"{C}, {_SEL} SELECT selection, nullif(concat_ws(' ', CASE WHEN count(DISTINCT model) > 1 THEN 'Different capital models.' END, CASE WHEN bool_or(activity = 'life') AND bool_or(activity = 'non-life') THEN 'Life and non-life mixed.' END, CASE WHEN count(DISTINCT perimeter) > 1 THEN 'Solo and group entities mixed.' END), '') AS warning FROM s GROUP BY 1")
def comparability_warning(spark, d):
    return cmp.warning_text(_selections(spark, d))


@query(K + "SELECT a.company_id, a.year, round(a.ratio_scr - b.ratio_scr, 6) AS variation, CASE WHEN abs(a.ratio_scr - b.ratio_scr) < 0.5 THEN 'stable' WHEN a.ratio_scr > b.ratio_scr THEN 'better' WHEN a.ratio_scr < b.ratio_scr THEN 'worse' END AS higher, CASE WHEN abs(a.own_funds - b.own_funds) < 0.01 THEN 'stable' WHEN a.own_funds < b.own_funds THEN 'better' WHEN a.own_funds > b.own_funds THEN 'worse' END AS lower FROM p a JOIN p b ON a.company_id = b.company_id AND a.year = b.year + 1")
def variation_sentiment(spark, d):
    w = indicators.wide(kpis(spark, d), ["ratio_scr", "own_funds"])
    before = w.select("company_id", (c("year") + 1).alias("year"), c("ratio_scr").alias("r"), c("own_funds").alias("f"))
    v, f = c("ratio_scr") - c("r"), c("own_funds") - c("f")
    return w.join(before, ["company_id", "year"]).select("company_id", "year", F.round(v, 6).alias("variation"), cmp.sentiment(v, "higher", "pts").alias("higher"), cmp.sentiment(f, "lower", "MEUR").alias("lower"))


@query(f"""{K}, m AS (SELECT company_id, company_id % 50 AS selection, year, kpi_name, round(value / nullif(s, 0) * 100, 1) AS share FROM kpis JOIN (SELECT company_id, year, sum(value::DECIMAL(38,6))::DOUBLE AS s FROM kpis WHERE kpi_name LIKE 'tier%' GROUP BY ALL HAVING sum(value) > 0 AND count(value) >= 4) USING (company_id, year) WHERE kpi_name LIKE 'tier%' AND year = 1997),
x AS (SELECT selection, company_id, max(share) AS g FROM m GROUP BY ALL HAVING count(share) = 4) SELECT selection, count(*) AS companies, least(100, greatest(10, ceil(max(g) / 10) * 10))::DOUBLE AS scale FROM x GROUP BY 1""")
def radar_scale(spark, d):
    tiers = ["tier1", "tier1_restricted", "tier2", "tier3"]
    shares = indicators.composition(kpis(spark, d).where("year = 1997"), tiers).withColumn("selection", c("company_id") % 50)
    return cmp.radar(shares, tiers)


@query(f"""{K}, r AS (SELECT *, own_funds - coalesce(tier1, 0) - coalesce(tier1_restricted, 0) - coalesce(tier2, 0) - coalesce(tier3, 0) AS rest FROM p)
SELECT company_id, year, 'tier1' AS line, tier1 AS value FROM r WHERE tier1 IS NOT NULL UNION ALL SELECT company_id, year, 'tier1_restricted', tier1_restricted FROM r WHERE tier1_restricted IS NOT NULL UNION ALL SELECT company_id, year, 'tier2', tier2 FROM r WHERE tier2 IS NOT NULL UNION ALL SELECT company_id, year, 'tier3', tier3 FROM r WHERE tier3 IS NOT NULL
UNION ALL SELECT company_id, year, 'adjustment', rest FROM r WHERE abs(rest) >= 0.01 * abs(own_funds) AND company_id % 23 <> 0""")
def breakdown_lines(spark, d):
    tiers = ["tier1", "tier1_restricted", "tier2", "tier3"]
    return cmp.breakdown(indicators.wide(kpis(spark, d), [*tiers, "own_funds"]), tiers, "own_funds", c("company_id") % 23 == 0)


@query(K + "SELECT company_id, year, CASE WHEN company_id % 3 <> 0 AND mcr IS NOT NULL AND ratio_scr IS NOT NULL THEN 'published' WHEN company_id % 3 = 0 AND ratio_scr IS NOT NULL THEN 'none' ELSE 'unavailable' END AS state FROM p")
def publication_state(spark, d):
    w = indicators.wide(kpis(spark, d), ["ratio_scr", "mcr"])
    return w.select("company_id", "year", cmp.publication(c("ratio_scr"), c("mcr"), c("company_id") % 3 != 0).alias("state"))


@query(K + "SELECT kpi_name, year, least(0.0, 100.0, min(value))::DOUBLE AS low, greatest(0.0, 100.0, max(value))::DOUBLE AS high FROM kpis GROUP BY ALL")
def axis_bounds(spark, d):
    return cmp.axis_bounds(kpis(spark, d), ["kpi_name", "year"], 100.0)


@query(CK + "SELECT company_id, year, kpi_name, CASE WHEN kpi_name = 'mcr' AND perimeter = 'group' THEN 'group minimum' WHEN value < 1 OR value > 500 THEN 'atypical' END AS warning FROM kpis JOIN companies USING (company_id)")
def value_warnings(spark, d):
    return kpis(spark, d).join(companies(spark, d), "company_id").select("company_id", "year", "kpi_name", cmp.atypical(c("kpi_name"), c("perimeter"), c("value"), 1.0, 500.0).alias("warning"))


# --- functions that had no query ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS available, floor(o_totalprice * 10 + 0.5) / 10 AS half_up, replace(regexp_replace(regexp_replace(printf('%.3f', round(o_totalprice, 3)), '0+$', ''), '\\.$', ''), '.', ',') AS csv FROM orders")
def figure_functions(spark, d):
    v = F.when(c("o_orderkey") % 5 == 0, float("inf")).otherwise(c("o_totalprice").cast("double"))
    return table(spark, d, "orders").select("o_orderkey", numbers.available(v).alias("available"), numbers.half_up(c("o_totalprice"), 1).alias("half_up"), numbers.csv_number(c("o_totalprice").cast("double")).alias("csv"))


@query("SELECT s_suppkey, true AS fragment, false AS word, s_suppkey + 0.25 AS amount, 2 AS decimals FROM supplier")
def printed_amounts(spark, d):
    shown = F.concat(c("s_suppkey").cast("string"), F.lit(",25"))
    amount, decimals = numbers.parse_amount(shown)
    return table(spark, d, "supplier").select("s_suppkey", numbers.is_fragment(shown).alias("fragment"), numbers.is_fragment(F.lit("about 5")).alias("word"), amount.alias("amount"), decimals.alias("decimals"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key, 1 + p_size % 3 AS level, p_size % 2 = 0 AS jargon, 'b > c' AS last, p_brand AS clean FROM part")
def text_functions(spark, d):
    title = F.concat(F.lit("B"), F.repeat(F.lit(".1"), c("p_size") % 3), F.lit(" Title"))
    note = F.when(c("p_size") % 2 == 0, "see row R0210").otherwise("see the row")
    path = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "part").select("p_partkey", text.alphanumeric_key(c("p_brand")).alias("key"), text.title_level(title).alias("level"), text.has_jargon(note).alias("jargon"), text.last_segments(path).alias("last"), text.private_removed(F.concat(F.lit(" "), "p_brand")).alias("clean"))


@query("""WITH m AS (SELECT l_partkey AS kpi, l_linenumber AS priority, 'S.' || lpad((l_suppkey % 30)::VARCHAR, 2, '0') || '.01' AS template, unnest(['R' || lpad((l_quantity::BIGINT * 10)::VARCHAR, 4, '0'), 'R' || lpad((l_linenumber * 10)::VARCHAR, 4, '0')]) AS code FROM lineitem),
t AS (SELECT kpi, template, min(priority) AS p FROM m GROUP BY ALL) SELECT kpi, string_agg(template, ',' ORDER BY p, template) AS templates, (SELECT array_to_string(list_sort(list_distinct(list(code))), ',') FROM m WHERE m.kpi = t.kpi) AS row_codes FROM t GROUP BY kpi""")
def template_lists(spark, d):
    """A part is an indicator, its lines the variants of where it is found."""
    four = lambda x: F.concat(F.lit("R"), F.lpad((x * 10).cast("string"), 4, "0"))
    m = table(spark, d, "lineitem").select(c("l_partkey").alias("kpi"), c("l_linenumber").alias("priority"), F.concat(F.lit("S."), F.lpad((c("l_suppkey") % 30).cast("string"), 2, "0"), F.lit(".01")).alias("template"), F.array(four(c("l_quantity").cast("long")), four(c("l_linenumber"))).alias("rows"))
    out = reading.template_lists(m, "kpi")
    return out.select("kpi", F.array_join("templates", ",").alias("templates"), F.array_join("row_codes", ",").alias("row_codes"))


@query(K + "SELECT company_id, count(*) FILTER (value IS NOT NULL AND year % 3 <> 0) AS by_code, count(*) FILTER (value IS NOT NULL AND year % 3 = 0) AS by_label, count(*) FILTER (value IS NULL) AS missing, count(*) AS n, floor(count(value) * 1000 / count(*)::DOUBLE) / 10 AS score FROM kpis GROUP BY 1")
def batch_scores(spark, d):
    """Every third year's figures were found by their labels."""
    k = kpis(spark, d).select("company_id", "value", F.when(c("year") % 3 == 0, "label").otherwise("code").alias("how"))
    return reading.batch_scores(k, "company_id")
