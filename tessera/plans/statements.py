"""Queries on statements that orders print as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import statements
from tessera.plans.queries import c, query
from tessera.session import table

KEY = ["company_id", "page_no"]
SECTIONS = [("premiums", "Earned premiums", "Claims incurred"), ("claims", "claims incurred", "Other costs")]
SETS = [["Gross - direct", "Gross - accepted"], ["Net of reinsurance"]]
WANTED = [("gross", 0, "Gross - direct", 0, False), ("gross", 1, "Gross - accepted", 2, False), ("net", 0, "net of reinsurance", -1, True), ("life", 0, "Life", 0, False), ("other", 0, "Other six", 1, False), ("other", 1, "Other seven", 0, True)]


def lines(spark, d) -> DataFrame:
    """Statements: two sections with labels on one or two lines and figures in columns, on one line or several, some unreadable."""
    o = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("company_id"))
    pages = o.withColumn("page_no", F.row_number().over(Window.partitionBy("company_id").orderBy("o_orderkey")))
    li = table(spark, d, "lineitem").select("l_orderkey", c("l_linenumber").alias("n"), c("l_quantity").cast("long").alias("q"), F.floor(c("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))
    n, q = c("n"), c("q")
    g = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))
    both = li.join(pages, c("l_orderkey") == c("o_orderkey")).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    amount = g(c("cents") + c("s"))
    text = F.when((n == 1) & (q % 2 == 1), F.array(F.lit("Gross -"), F.lit("direct"), F.concat(amount, F.lit("  "), q)))
    text = text.when(n == 1, F.array(F.lit("GROSS  - Dírect"), F.concat(amount, F.lit(",50   "), q, F.lit(" %"))))
    text = text.when(n == 2, F.array(F.lit("Gross - accepted"), amount, F.lit(" "), F.concat(q.cast("string"), F.lit("  "), amount)))
    text = text.when(n == 3, F.array(F.lit("Net of reinsurance"), F.concat(F.lit("-  ("), amount, F.lit(")"))))
    text = text.when(n == 4, F.array(F.lit("Life"), F.lit("1,2,3"), amount))
    text = text.when(n == 5, F.array(F.lit("All business, gross - direct"), amount, F.lit("4,5,6"), amount))
    text = text.when(n == 6, F.array(F.lit("Other six"), amount)).otherwise(F.array(F.lit("Other seven"), amount, F.concat(q.cast("string"), F.lit("  1"))))
    rows = both.select("company_id", "page_no", "s", "n", "cents", "q", F.posexplode(text).alias("k", "line"))
    heads = pages.select("company_id", "page_no", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(x).alias("line")) for s, x in ((0, "Earned premiums"), (1, "Claims  INCURRED"), (2, "Other costs"), (2, "12  34"))])).alias("h"))
    heads = heads.select("company_id", "page_no", "h.s", F.when(c("h.line") == "12  34", 1).otherwise(0).alias("n"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("k"), "h.line")
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("s", "n", "cents", "q", "k"))
    return rows.unionByName(heads).withColumn("line_no", at).select(*KEY, "line_no", "line")


_G = lambda x: f"trim(regexp_replace(reverse(regexp_replace(reverse(({x})::VARCHAR), '([0-9]{{3}})', '\\1 ', 'g')), '^ ', ''))"
_NORM = lambda x: f"trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g'))"
_NUMBER = """CASE WHEN regexp_matches(y, '^[-−–]$') THEN 0.0 WHEN y LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(y[:-2] AS DOUBLE) / 100 ELSE TRY_CAST(y AS DOUBLE) END"""
_AMOUNT = _G("cents + s")
_LINES = f"""pg AS (SELECT o_orderkey, o_custkey AS company_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no FROM orders),
rw AS (SELECT company_id, page_no, s, l_linenumber AS n, l_quantity::BIGINT AS q, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents FROM lineitem JOIN pg ON l_orderkey = o_orderkey, (VALUES (0), (1)) v(s)),
tx AS (SELECT *, CASE WHEN n = 1 AND q % 2 = 1 THEN ['Gross -', 'direct', {_AMOUNT} || '  ' || q] WHEN n = 1 THEN ['GROSS  - Dírect', {_AMOUNT} || ',50   ' || q || ' %'] WHEN n = 2 THEN ['Gross - accepted', {_AMOUNT}, ' ', q || '  ' || {_AMOUNT}]
  WHEN n = 3 THEN ['Net of reinsurance', '-  (' || {_AMOUNT} || ')'] WHEN n = 4 THEN ['Life', '1,2,3', {_AMOUNT}] WHEN n = 5 THEN ['All business, gross - direct', {_AMOUNT}, '4,5,6', {_AMOUNT}] WHEN n = 6 THEN ['Other six', {_AMOUNT}] ELSE ['Other seven', {_AMOUNT}, q || '  1'] END AS t FROM rw),
ln AS MATERIALIZED (SELECT company_id, page_no, line, row_number() OVER (PARTITION BY company_id, page_no ORDER BY s, n, cents, q, k) AS line_no FROM (
  SELECT company_id, page_no, s, n, cents, q, generate_subscripts(t, 1) AS k, unnest(t) AS line FROM tx
  UNION ALL SELECT company_id, page_no, s, n, 0, 0, 0, line FROM pg, (VALUES (0, 0, 'Earned premiums'), (1, 0, 'Claims  INCURRED'), (2, 0, 'Other costs'), (2, 1, '12  34')) v(s, n, line)))"""


def _folded_sql(source: str, key: str, out: str) -> str:
    return f"""{out}a AS (SELECT {key}, line_no, line, regexp_matches(trim(line), '^[-−–\\d\\s.,%()]+$') AS fig FROM {source} WHERE trim(line) <> ''),
{out}b AS (SELECT *, CASE WHEN fig THEN list_transform(list_filter(string_split_regex(trim(line), '\\s{{2,}}'), lambda x: trim(x) <> ''), lambda x: regexp_replace(replace(regexp_replace(x, '\\s', '', 'g'), ',', '.'), '^\\((.*)\\)$', '-\\1')) END AS toks, (NOT fig AND coalesce(lag(fig) OVER (PARTITION BY {key} ORDER BY line_no), true))::INT AS starts FROM {out}a),
{out}c AS (SELECT *, CASE WHEN fig THEN [{_NUMBER} FOR y IN toks] END AS vals, sum(starts) OVER (PARTITION BY {key} ORDER BY line_no) AS run FROM {out}b),
{out}d AS (SELECT *, max(coalesce(fig AND len(list_filter(vals, lambda v: v IS NULL)) > 0, false)::INT) OVER (PARTITION BY {key}, run ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS broken FROM {out}c),
{out} AS MATERIALIZED (SELECT {key}, run::BIGINT AS pair_no, {_NORM("string_agg(trim(line), ' ' ORDER BY line_no) FILTER (NOT fig)")} AS label, flatten(list(vals ORDER BY line_no) FILTER (fig AND broken = 0)) AS vals FROM {out}d WHERE run > 0 GROUP BY {key}, run HAVING count(*) FILTER (fig AND broken = 0) > 0)"""


_SECTION = ", ".join(f"('{n}', {_NORM(repr(a))}, {_NORM(repr(z))})" for n, a, z in SECTIONS)
_SECTIONS_SQL = f"""sp AS (SELECT * FROM (VALUES {_SECTION}) v(section, a, z)),
sa AS (SELECT company_id, page_no, section, z, min(line_no) AS first FROM ln JOIN sp ON {_NORM('line')} = a GROUP BY ALL),
sz AS (SELECT sa.company_id, sa.page_no, section, first, min(line_no) AS last FROM sa LEFT JOIN ln ON ln.company_id = sa.company_id AND ln.page_no = sa.page_no AND line_no > first AND {_NORM('line')} = z GROUP BY ALL),
se AS MATERIALIZED (SELECT ln.*, section FROM ln JOIN sz USING (company_id, page_no) WHERE line_no >= first AND line_no < coalesce(last, 1000000000))"""
_WANT = lambda rows: ", ".join(f"('{n}', {p}, '{x}', {_NORM(repr(x))}, {at}, {str(add).lower()})" for n, p, x, at, add in rows)


def _label_sql(pairs: str, key: str, wanted: list, out: str) -> str:
    return f"""{out}w AS (SELECT * FROM (VALUES {_WANT(wanted)}) v(name, priority, asked, norm, spot, add_all)),
{out}m AS (SELECT {pairs}.*, w.*, label <> norm AS suffix, vals[CASE WHEN spot < 0 THEN spot ELSE spot + 1 END] AS v FROM {pairs} JOIN {out}w w ON label = norm OR ends_with(label, ' ' || norm)),
{out}g AS (SELECT {key}, name, priority, asked, add_all, suffix, arg_min({{'v': v}}, pair_no).v AS one, sum(v::DECIMAL(38,6))::DOUBLE AS total FROM {out}m GROUP BY ALL),
{out}p AS (SELECT * FROM {out}g QUALIFY suffix = min(suffix) OVER (PARTITION BY {key}, name, priority)),
{out} AS (SELECT {key}, name, arg_min(CASE WHEN add_all THEN coalesce(total, 0) ELSE one END, priority) AS value, arg_min(asked, priority) AS label FROM {out}p WHERE add_all OR one IS NOT NULL GROUP BY ALL)"""


_K = "company_id, page_no"
_PAIRS = _folded_sql("ln", _K, "fo")


@query(f"WITH {_LINES}, {_PAIRS} SELECT company_id, page_no, pair_no, label, len(vals)::INT AS n, round(list_sum(vals), 6) AS total, vals[-1] AS last FROM fo")
def folded_lines(spark, d):
    x = statements.folded(lines(spark, d), KEY)
    return x.select(*KEY, "pair_no", "label", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.element_at("values", -1).alias("last"))


@query(f"WITH {_LINES}, {_SECTIONS_SQL} SELECT company_id, page_no, section, count(*) AS n, min(line_no) AS first, max(line_no) AS last FROM se GROUP BY ALL")
def section_slices(spark, d):
    return statements.sections(lines(spark, d), KEY, SECTIONS).groupBy(*KEY, "section").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


@query(f"WITH {_LINES}, {_PAIRS}, {_label_sql('fo', _K, WANTED, 'lb')} SELECT company_id, page_no, name, value, label FROM lb")
def figures_by_label(spark, d):
    return statements.by_label(statements.folded(lines(spark, d), KEY), KEY, WANTED)


_SET_WANTED = [(f"{i}:{x}", 0, x, -1, False) for i, labels in enumerate(SETS) for x in labels]


@query(f"WITH {_LINES}, {_SECTIONS_SQL}, {_folded_sql('se', _K + ', section', 'fs')}, {_label_sql('fs', _K + ', section', _SET_WANTED, 'lt')}, st AS (SELECT *, name[1] AS set_no FROM lt QUALIFY set_no = min(set_no) OVER (PARTITION BY company_id, page_no, section)) SELECT company_id, section, round(sum(value::DECIMAL(38,6))::DOUBLE, 6) AS total, count(*) AS parts FROM st GROUP BY ALL")
def section_label_totals(spark, d):
    return statements.section_totals(lines(spark, d), ["company_id"], "page_no", SECTIONS, SETS)


SUFFIXES = {"gross": ["- direct", "- accepted"], "net": ["Reinsurance"]}


@query(f"""WITH {_LINES}, {_PAIRS}, sx AS (SELECT company_id, page_no, 'gross' AS name, vals[-1] AS v FROM fo WHERE ends_with(label, '- direct') OR ends_with(label, '- accepted') UNION ALL SELECT company_id, page_no, 'net', vals[-1] FROM fo WHERE ends_with(label, 'reinsurance'))
SELECT company_id, page_no, name, round(sum(v::DECIMAL(38,6))::DOUBLE, 6) AS total, count(*) AS parts FROM sx GROUP BY ALL""")
def suffix_label_totals(spark, d):
    return statements.suffix_totals(statements.folded(lines(spark, d), KEY), KEY, SUFFIXES)


def _signs(spark, d) -> DataFrame:
    """An order's lines: the label, then its figure and signs, whole or in another form."""
    o = table(spark, d, "orders")
    v, k = F.floor(c("o_totalprice")).cast("long").cast("string"), c("o_orderkey") % 5
    after = F.when(k == 0, F.array(v, F.lit("-"), v, F.lit("-"))).when(k == 1, F.array(F.lit("-"), v, F.lit("-"), v)).when(k == 2, F.array(v, F.lit("-"), F.concat(v, F.lit("0")), F.lit("-"))).when(k == 3, F.array(v, F.lit("-"))).otherwise(F.array(F.concat(v, F.lit(",5")), F.lit("-"), F.concat(v, F.lit(",5")), F.lit("-"), F.lit("-")))
    head = F.when(c("o_orderkey") % 3 == 0, F.array(F.lit("Premiums, gross"), F.lit("TOTAL"))).otherwise(F.array(F.lit("Total"), F.lit("Premiums")))
    label = F.when(c("o_orderkey") % 7 == 0, "Spreading").otherwise("Diversification")
    return o.select("o_orderkey", F.posexplode(F.concat(head, F.array(label, F.lit(" ")), after)).alias("line_no", "line"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -floor(o_totalprice) WHEN 4 THEN -(floor(o_totalprice) + 0.5) END AS value FROM orders WHERE o_orderkey % 7 <> 0""")
def signs_reattached(spark, d):
    return statements.detached_signs(_signs(spark, d), ["o_orderkey"], "Diversification")


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS has_total FROM orders")
def total_columns(spark, d):
    return statements.with_total_column(_signs(spark, d), ["o_orderkey"], "Total", "premiums")


@query("SELECT c_custkey, c_name, n_name || ' / ' || c_mktsegment AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'solo' ELSE 'group' END AS perimeter FROM customer JOIN nation ON c_nationkey = n_nationkey")
def companies_with_metadata(spark, d):
    from tessera.operators import warehouse

    x, n = table(spark, d, "customer"), table(spark, d, "nation")
    meta = x.join(n, c("c_nationkey") == c("n_nationkey")).select("c_custkey", F.concat("n_name", F.lit(" / "), "c_mktsegment").alias("c_mktsegment"), F.when(c("c_custkey") % 2 == 0, "solo").otherwise("group").alias("perimeter"))
    extra = meta.withColumn("c_custkey", -c("c_custkey") - 1)
    return warehouse.with_metadata(x.select("c_custkey", "c_name", "c_mktsegment"), meta.unionByName(extra), "c_custkey", ["c_mktsegment", "perimeter"])
