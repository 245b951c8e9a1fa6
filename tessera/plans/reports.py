"""Queries on reports laid over orders: where figures are printed, and what corrections change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import source_pages
from tessera.plans.queries import c, query
from tessera.session import table

_FAR = "Risk margin of the year, as the chapter on valuation and both of its annexes tell it in detail: "
ANCHORS = [("kpi1", ["R0010"], []), ("kpi2", [], ["Best Estimate"]), ("kpi3", ["R0030"], ["risk margin"]), ("kpi5", [], ["quantity of"]), ("kpi6", ["R0060"], []), ("kpi7", ["R0060"], [])]

#: Lines of reports that are dealt to one task, about.
LINES = 250_000


def _grouped(x):
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def _cents(x):
    return F.floor(x * 100 + 0.5).cast("long")


def _lines(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pages = o.withColumn("page_no", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", _cents(c("l_extendedprice")).alias("cents"))
    return rows.join(pages, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("company_id"), "page_no", "l_linenumber", "l_quantity", "l_discount", "cents")


def report_pages(lines: DataFrame) -> DataFrame:
    """One page an order: codes, labels and figures, with narrow spaces in some; what the page before said is told again."""
    n, cents = c("l_linenumber"), c("cents")
    text = F.when(n == 1, F.concat(F.lit("R0010\n    "), F.replace(_grouped(cents), F.lit(" "), F.lit(" ")))).when(n == 2, F.concat(F.lit("best estimate "), cents.cast("string"))).when(n == 3, F.concat(F.lit(_FAR), _grouped(cents)))
    text = text.when(n == 4, F.concat(F.lit("rate "), F.floor(c("l_discount") * 100 + 0.5).cast("string"), F.lit(" %"))).when(n == 5, F.concat(F.lit("quantity of "), c("l_quantity").cast("long").cast("string"))).otherwise(F.concat(F.lit("R0060 total "), F.replace(F.format_number(cents / 1000, 3), F.lit(","), F.lit(" "))))
    own = F.struct(c("page_no").alias("page_no"), n.alias("n"), text.alias("line"))
    again = F.struct((c("page_no") + 1).alias("page_no"), (n + 10).alias("n"), F.when(n == 1, F.concat(F.lit("carried "), _grouped(cents))).otherwise(F.concat(F.lit("before: best estimate "), cents.cast("string"))).alias("line"))
    told_in = F.when(n <= 2, F.array(own, again)).otherwise(F.array(own))
    both = lines.select("company_id", F.inline(told_in))
    told = F.struct("n", source_pages.plain_spaces(c("line")).alias("plain"), "line")  # lines of a number stand in order of what they say, whatever their spaces
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["line"]), "\n")
    return both.groupBy("company_id", "page_no").agg(joined.alias("text"))


def figures(lines: DataFrame) -> DataFrame:
    """A figure for each line of a company's second page (the first where there is one only); some null or 0, some given in thousandths."""
    w = Window.partitionBy("company_id", "l_linenumber").orderBy(F.when(c("page_no") == 2, 0).otherwise(1), "page_no", "cents", "l_quantity", "l_discount")
    one = lines.withColumn("r", F.row_number().over(w)).where("r = 1")
    n, k = c("l_linenumber"), c("company_id")
    value = F.when(n == 4, F.floor(c("l_discount") * 100 + 0.5).cast("double")).when(n == 5, c("l_quantity")).when(n >= 6, c("cents") / 1000).otherwise(c("cents").cast("double"))
    value = F.when(k % 11 == 0, F.when(n % 2 == 0, 0.0)).otherwise(value)
    others = F.when((n <= 2) & (k % 5 == 0), F.array(c("cents") / 1000, F.rint(c("cents") / 1000)))
    return one.select("company_id", F.concat(F.lit("kpi"), n.cast("string")).alias("kpi_name"), value.alias("value"), others.alias("others"), (n == 4).alias("is_pct"), F.lit(1).alias("page_min"), F.when(k % 4 == 0, 3).alias("page_max"), (k % 3 + 1).cast("int").alias("source_page"))


def _found(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    anchors = spark.createDataFrame(ANCHORS, "kpi_name string, codes array<string>, labels array<string>")
    n, kinds = table(spark, d, "lineitem").agg(F.count("*"), F.count_distinct("l_linenumber")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LINES))  # a number that is given is kept: a line is little to read and much to do
    lines = lines.repartition(parts, "company_id")  # as lines, not as texts; pages, figures and the search take no other shuffle
    return source_pages.find_pages(figures(lines), report_pages(lines), anchors, ["company_id"], kinds + 1)  # a figure is one of a line number, or of none


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


_G = lambda x: f"trim(regexp_replace(reverse(regexp_replace(reverse(({x})::VARCHAR), '([0-9]{{3}})', '\\1 ', 'g')), '^ ', ''))"
_K = lambda x: f"({_G(f'({x}) // 1000')} || '.' || lpad((({x}) % 1000)::VARCHAR, 3, '0'))"
_WINDOW = lambda reach: f"substr(text, greatest(pos - {reach}, 0) + 1, pos + {reach} - greatest(pos - {reach}, 0))"
REPORTS_SQL = f"""o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no FROM orders),
li AS (SELECT o_custkey AS company_id, page_no, l_linenumber AS n, l_quantity, floor(l_discount * 100 + 0.5)::BIGINT AS rate, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents FROM lineitem JOIN o ON l_orderkey = o_orderkey),
pl AS (SELECT company_id, page_no, n, CASE n WHEN 1 THEN 'R0010' || chr(10) || '    ' || {_G('cents')} WHEN 2 THEN 'best estimate ' || cents WHEN 3 THEN '{_FAR}' || {_G('cents')} WHEN 4 THEN 'rate ' || rate || ' %' WHEN 5 THEN 'quantity of ' || l_quantity::BIGINT ELSE 'R0060 total ' || {_K('cents')} END AS line FROM li
  UNION ALL SELECT company_id, page_no + 1, n + 10, CASE n WHEN 1 THEN 'carried ' || {_G('cents')} ELSE 'before: best estimate ' || cents END FROM li WHERE n <= 2),
pg AS (SELECT company_id, page_no, string_agg(line, chr(10) ORDER BY n, line) AS text FROM pl GROUP BY ALL),
fg AS (SELECT company_id, 'kpi' || n AS kpi_name, n, cents, CASE WHEN company_id % 11 = 0 THEN CASE WHEN n % 2 = 0 THEN 0.0 END WHEN n = 4 THEN rate::DOUBLE WHEN n = 5 THEN l_quantity WHEN n >= 6 THEN cents / 1000 ELSE cents::DOUBLE END AS value, CASE WHEN n = 4 THEN rate WHEN n = 5 THEN l_quantity::BIGINT ELSE cents END AS whole,
  CASE WHEN company_id % 4 = 0 THEN 3 END AS page_max, (company_id % 3 + 1)::INT AS source_page FROM li QUALIFY row_number() OVER (PARTITION BY company_id, n ORDER BY CASE WHEN page_no = 2 THEN 0 ELSE 1 END, page_no, cents, l_quantity, rate) = 1),
three AS (SELECT company_id, kpi_name, cents AS x FROM fg WHERE value <> 0 AND (n >= 6 OR (n <= 2 AND company_id % 5 = 0))),
fo AS (SELECT company_id, kpi_name, unnest([{_G('whole')}, whole::VARCHAR]) AS form FROM fg WHERE value <> 0 AND n < 6
  UNION SELECT company_id, kpi_name, unnest(CASE WHEN x % 1000 = 0 THEN [{_G('x // 1000')}, (x // 1000)::VARCHAR] ELSE [{_K('x')}] END) FROM three
  UNION SELECT company_id, kpi_name, unnest([{_G('r')}, r::VARCHAR]) FROM (SELECT company_id, kpi_name, round_even(x / 1000, 0)::BIGINT AS r FROM fg JOIN three USING (company_id, kpi_name) WHERE n <= 2)),
hit AS (SELECT company_id, kpi_name, n, page_no, text, unnest(list_filter(range(length(text)), lambda i: substr(text, i + 1, length(form)) = form AND (n <> 4 OR regexp_matches(substr(text, i + 1 + length(form), 10), '^\\s*%')))) AS pos FROM fo JOIN fg USING (company_id, kpi_name) JOIN pg USING (company_id) WHERE page_no <= coalesce(page_max, 1000000) AND contains(text, form)),
an AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_sql_list(a)}, {_sql_list(b)})" for k, a, b in ANCHORS)}) AS t(kpi_name, codes, labels)),
op AS (SELECT company_id, kpi_name, page_no, bool_or(coalesce(len(list_filter(codes, lambda w: contains({_WINDOW(40)}, w))) > 0, false)) AS code, bool_or(coalesce(len(list_filter(labels, lambda w: contains(lower({_WINDOW(80)}), lower(w)))) > 0, false)) AS label FROM hit LEFT JOIN an USING (kpi_name) GROUP BY ALL),
se AS (SELECT company_id, kpi_name, count(*) AS np, min(page_no) AS p0, count(*) FILTER (code) AS nc, min(page_no) FILTER (code) AS pc, count(*) FILTER (label) AS nl, min(page_no) FILTER (label) AS l0, max(page_no) FILTER (label) AS l1 FROM op GROUP BY ALL),
fp AS (SELECT fg.*, np, CASE WHEN np IS NULL THEN NULL WHEN np = 1 THEN p0 WHEN nc = 1 THEN pc WHEN nc > 1 THEN NULL WHEN nl = 1 THEN l0 WHEN nl > 1 AND l1 - l0 <= 2 THEN l1 END::INT AS page,
  CASE WHEN np IS NULL THEN 0 WHEN np = 1 OR nc = 1 THEN 1 WHEN nc > 1 THEN nc WHEN nl = 1 OR (nl > 1 AND l1 - l0 <= 2) THEN 1 WHEN nl > 1 THEN nl ELSE np END AS candidates,
  CASE WHEN value IS NULL OR value = 0 THEN 'null or 0' WHEN np IS NULL THEN 'not found' WHEN np = 1 THEN 'only page' WHEN nc = 1 THEN 'code near' WHEN nc > 1 THEN 'codes near on several pages' WHEN nl = 1 THEN 'label near' WHEN nl > 1 AND l1 - l0 <= 2 THEN 'last of neighbouring pages with the label' WHEN nl > 1 THEN 'labels near on several pages' ELSE 'several pages' END AS reason FROM fg LEFT JOIN se USING (company_id, kpi_name))"""


@query(f"WITH {REPORTS_SQL} SELECT company_id, kpi_name, value, page, candidates, reason FROM fp")
def source_page_finder(spark, d):
    return _found(spark, d).select("company_id", "kpi_name", "value", "page", "candidates", "reason")


@query(f"WITH {REPORTS_SQL} SELECT company_id, kpi_name, source_page AS old_page, page AS new_page, reason, CASE WHEN page IS NOT NULL THEN 'corrected' WHEN candidates = 0 THEN 'missing' ELSE 'open' END AS state FROM fp WHERE page IS NULL OR page <> source_page")
def source_page_journal(spark, d):
    return source_pages.journal(_found(spark, d), ["company_id"])


@query(f"WITH {REPORTS_SQL} SELECT company_id, kpi_name, value, coalesce(page, source_page) AS source_page FROM fp")
def source_pages_corrected(spark, d):
    return source_pages.corrected(_found(spark, d)).select("company_id", "kpi_name", "value", "source_page")
