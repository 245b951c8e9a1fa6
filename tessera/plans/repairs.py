"""Queries of repaired tables, nested snapshots, and functions that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import documents, repair, snapshots, warehouse
from tessera.plans.queries import c, query
from tessera.session import table

# --- rows run together --------------------------------------------------------------------------------------------------

#: A fixed reference list, in its order.
REFERENCE = [(name, name) for name in "North Coast,Upper Valley,Lake Country,Old Harbour,East Plains,River Bend,High Moor,South Dunes,West Isles,Far Hills,Green Downs,Long Shore".split(",")]


def _tables(spark, d) -> DataFrame:
    """A table a customer: eight entries of the list and a total; by customer sound, or with one trouble or other.

    Customers are dealt by table before their rows are made, so what is done to a table moves no row again."""
    k = c("c_custkey")
    names = F.array(*[F.lit(n) for n, _ in REFERENCE])
    entry = lambda i: F.get(names, (k % 5 + i).cast("int"))
    upper, lower, kind = c("i") == 3, c("i") == 4, k % 10
    both = F.concat(entry(F.lit(3)), F.lit(" "), F.lower(entry(F.lit(4))))
    plain = F.concat(F.lit("Branch of "), entry(c("i")))
    label = F.when(c("i") == 8, "TOTAL").when((kind == 1) & upper, "").when((kind == 1) & lower, both).when((kind == 2) & upper, both).when((kind == 2) & lower, " ")
    label = label.when((kind == 3) & upper, "").when((kind == 3) & lower, F.concat(entry(F.lit(4)), F.lit(" & "), entry(F.lit(6)))).when((kind == 4) & upper, "Somewhere else").when((kind == 5) & (upper | (c("i") == 6)), "")
    label = label.when((kind == 6) & (c("i") == 1), "").when((kind == 6) & lower, both).when((kind == 7) & (c("i") == 0), "").when((kind == 7) & (c("i") == 1), F.concat(entry(F.lit(0)), F.lit(" "), entry(F.lit(1)))).when((kind == 8) & (c("i") == 2), entry(F.lit(7)))
    return table(spark, d, "customer").select("c_custkey").repartition("c_custkey").select(c("c_custkey").alias("table_id"), "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("table_id", c("i").alias("row_no"), label.otherwise(plain).alias("label"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in REFERENCE) + "]"
_E = lambda i: f"{_NAMES}[c_custkey % 5 + {i} + 1]"
_TABLES = f"""tb AS (SELECT c_custkey AS table_id, i::INT AS row_no, CASE WHEN i = 8 THEN 'TOTAL' WHEN k = 1 AND i = 3 THEN '' WHEN k = 1 AND i = 4 THEN {_E(3)} || ' ' || lower({_E(4)}) WHEN k = 2 AND i = 3 THEN {_E(3)} || ' ' || lower({_E(4)}) WHEN k = 2 AND i = 4 THEN ' '
  WHEN k = 3 AND i = 3 THEN '' WHEN k = 3 AND i = 4 THEN {_E(4)} || ' & ' || {_E(6)} WHEN k = 4 AND i = 3 THEN 'Somewhere else' WHEN k = 5 AND i IN (3, 6) THEN '' WHEN k = 6 AND i = 1 THEN '' WHEN k = 6 AND i = 4 THEN {_E(3)} || ' ' || lower({_E(4)})
  WHEN k = 7 AND i = 0 THEN '' WHEN k = 7 AND i = 1 THEN {_E(0)} || ' ' || {_E(1)} WHEN k = 8 AND i = 2 THEN {_E(7)} ELSE 'Branch of ' || {_E('i')} END AS label FROM (SELECT *, c_custkey % 10 AS k, unnest(range(9)) AS i FROM customer)),
ma AS (SELECT *, list_filter(range(12), lambda p: contains(' ' || lower(label) || ' ', ' ' || lower({_NAMES}[p + 1]) || ' ')) AS m FROM tb),
kd AS MATERIALIZED (SELECT *, CASE WHEN label = 'TOTAL' THEN 'total' WHEN trim(label) = '' THEN 'empty' WHEN len(m) = 0 THEN 'unknown' WHEN len(m) = 1 THEN 'single' ELSE 'merged' END AS kind FROM ma),
sg AS (SELECT table_id, row_no, m[1] AS place, lag(m[1]) OVER (PARTITION BY table_id ORDER BY row_no) AS prev FROM kd WHERE kind = 'single'),
su AS (SELECT table_id, count(*) AS singles, bool_and(prev IS NULL OR place > prev) AS rising FROM sg GROUP BY 1),
tg AS (SELECT table_id, count(*) FILTER (kind = 'empty') AS ne, count(*) FILTER (kind = 'merged') AS nm, count(*) FILTER (kind = 'unknown') AS nu, min(row_no) FILTER (kind = 'empty') AS er, min(row_no) FILTER (kind = 'merged') AS mr, max(m) FILTER (kind = 'merged') AS named FROM kd GROUP BY 1),
cx AS (SELECT table_id, max(place) FILTER (row_no < least(er, mr)) AS b, min(place) FILTER (row_no > greatest(er, mr)) AS a FROM sg JOIN tg USING (table_id) WHERE er IS NOT NULL AND mr IS NOT NULL GROUP BY 1),
dg AS (SELECT tg.*, b, CASE WHEN NOT rising OR singles < 5 THEN 'out of scope' WHEN ne + nm + nu = 0 THEN 'sound' WHEN nu > 0 THEN 'unknown label' WHEN ne <> 1 OR nm <> 1 THEN 'not one empty and one merged row' WHEN abs(er - mr) <> 1 THEN 'not side by side' WHEN a IS NULL OR b IS NULL THEN 'no row before or after' WHEN a - b <> 3 THEN 'gap of other than two' WHEN named <> [b + 1, b + 2] THEN 'others than the gap' ELSE 'repaired' END AS status FROM tg JOIN su USING (table_id) LEFT JOIN cx USING (table_id))"""


def _matched(spark, d) -> DataFrame:
    return repair.matched(_tables(spark, d), REFERENCE)


@query(f"WITH {_TABLES} SELECT table_id, status, CASE WHEN status = 'repaired' THEN er END AS empty_row, CASE WHEN status = 'repaired' THEN mr END AS merged_row, CASE WHEN status = 'repaired' THEN b + 1 END AS first_place FROM dg")
def row_repair_journal(spark, d):
    return repair.diagnosed(_matched(spark, d), 5)


@query(f"WITH {_TABLES} SELECT table_id, row_no, CASE WHEN status = 'repaired' AND row_no = least(er, mr) THEN {_NAMES}[b + 2] WHEN status = 'repaired' AND row_no = least(er, mr) + 1 THEN {_NAMES}[b + 3] ELSE label END AS label, status = 'repaired' AND row_no IN (er, mr) AS repaired FROM tb JOIN dg USING (table_id)")
def rows_repaired(spark, d):
    return repair.repaired(_tables(spark, d), repair.diagnosed(_matched(spark, d), 5), REFERENCE)


@query(f"WITH {_TABLES} SELECT table_id, row_no, label, len(m)::INT AS n, array_to_string(m, ',') AS matches FROM kd WHERE kind NOT IN ('total', 'single')")
def labels_flagged(spark, d):
    return repair.flagged_labels(_matched(spark, d)).withColumn("matches", F.array_join(c("matches").cast("array<string>"), ","))


# --- nested snapshots ---------------------------------------------------------------------------------------------------

IGNORED = [r"/meta/.*", r"/orders\[\d+\]/note"]


def _snapshot(spark, d, later: bool) -> DataFrame:
    """A tree a customer with its orders; the later one lacks, changes, adds and cuts off some."""
    o = table(spark, d, "orders")
    k, price = c("o_custkey"), (F.floor(c("o_totalprice") * 100 + 0.5) / 100)
    if later:
        price = F.when(c("o_orderkey") % 6 == 0, price + 1).otherwise(price)
    status = F.when(F.lit(later) & (c("o_orderkey") % 10 == 3), F.lit(None)).otherwise(c("o_orderstatus"))
    one = F.struct("o_orderkey", price.alias("price"), status.alias("status"), F.lit("new" if later else "old").alias("note"))
    g = o.groupBy(k.alias("c_custkey")).agg(F.sort_array(F.collect_list(one)).alias("orders"))
    j = table(spark, d, "customer").join(g, "c_custkey")
    n = c("c_custkey")
    orders = F.when(F.lit(later) & (n % 4 == 1), F.slice("orders", 1, 3)).otherwise(c("orders"))
    segment = F.when(F.lit(later) & (n % 5 == 2), F.lit(None)).otherwise(c("c_mktsegment"))
    profile = F.when(F.lit(later) & (n % 7 == 3), F.lit(None)).otherwise(F.struct(segment.alias("segment"), c("c_nationkey").alias("nation"), (c("c_nationkey") + (1 if later else 0) * (n % 3)).alias("score"), F.when(F.lit(later), F.lit("x")).alias("added")))
    tree = F.struct(c("c_name").alias("name"), profile.alias("profile"), orders.alias("orders"), F.struct(F.lit("later" if later else "before").alias("at")).alias("meta"))
    return j.select("c_custkey", F.to_json(tree).alias("json"))


_TREE = lambda later: f"""SELECT c_custkey, to_json({{'name': c_name, 'profile': {{'segment': c_mktsegment, 'nation': c_nationkey, 'score': c_nationkey + {'c_custkey % 3' if later else '0'}}}, 'orders': orders, 'meta': {{'at': '{later}'}}}}) AS t FROM customer JOIN (SELECT o_custkey AS c_custkey, list({{'o_orderkey': o_orderkey, 'price': floor(o_totalprice * 100 + 0.5) / 100 {'+ CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END' if later else ''}, 'status': o_orderstatus, 'note': '{later}'}} ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) USING (c_custkey)"""
_NODES = lambda t: f"SELECT c_custkey, replace(fullkey[2:], '.', '/') AS path, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type ELSE 'VALUE' END AS kind, atom AS value, CASE WHEN type = 'ARRAY' THEN json_array_length({t}.t, fullkey) END AS n FROM {t}, json_tree({t}.t)"
_DIFF = f"""ta AS MATERIALIZED ({_TREE(False)}), tz AS MATERIALIZED ({_TREE(True)}),
na AS MATERIALIZED ({_NODES('ta')}), nz0 AS ({_NODES('tz')}),
nz AS MATERIALIZED (SELECT * REPLACE (CASE WHEN path = '/orders' AND c_custkey % 4 = 1 THEN least(n, 3) ELSE n END AS n) FROM nz0 JOIN (SELECT o_custkey AS c_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1) USING (c_custkey)
  WHERE NOT (c_custkey % 4 = 1 AND regexp_matches(path, '^/orders\\[([3-9]|\\d\\d+)\\]')) AND NOT (c_custkey % 7 = 3 AND path LIKE '/profile%') AND NOT (c_custkey % 5 = 2 AND path = '/profile/segment')
  AND NOT (path LIKE '/orders[%/status' AND coalesce(ks[TRY_CAST(regexp_extract(path, '\\[(\\d+)\\]', 1) AS INT) + 1] % 10 = 3, false))),
df AS (SELECT na.c_custkey, na.path, CASE WHEN nz.path IS NULL THEN 'removed' WHEN na.kind <> nz.kind OR (na.kind = 'VALUE' AND na.value IS DISTINCT FROM nz.value) THEN 'changed' WHEN na.kind = 'ARRAY' AND na.n <> nz.n THEN 'resized' END AS change
  FROM na LEFT JOIN nz USING (c_custkey, path) WHERE NOT regexp_matches(na.path, '^/meta/') AND NOT regexp_matches(na.path, '^/orders\\[\\d+\\]/note'))"""


@query(f"WITH {_DIFF} SELECT c_custkey, path, change FROM df WHERE change IS NOT NULL AND NOT (change = 'removed' AND (path LIKE '/profile/%' AND c_custkey % 7 = 3 OR c_custkey % 4 = 1 AND regexp_matches(path, '^/orders\\[([3-9]|\\d\\d+)\\]')))")
def nested_changes(spark, d):
    return snapshots.kept_additions(_snapshot(spark, d, False), _snapshot(spark, d, True), "c_custkey", IGNORED, depth=4)


# --- functions ----------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(list_filter(list_zip(w, w[2:]), lambda z: z[2] IS NOT NULL AND regexp_matches(z[1], '\pL{3,}$') AND regexp_matches(z[2], '^\p{Ll}{1,3}([^\pL\pN_]|$)') AND NOT list_contains(['the', 'of', 'and', 'to', 'in', 'is', 'a'], regexp_extract(z[2], '^\p{Ll}+'))))::INT AS broken FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def broken_words(spark, d):
    found = text.broken_words(c("text"), ["the", "of", "and", "to", "in", "is", "a"])
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("broken"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '−' ELSE '' END || trim(regexp_replace(reverse(regexp_replace(reverse((tenths // 10)::VARCHAR), '([0-9]{3})', '\\1 ', 'g')), '^ ', '')) || ',' || (tenths % 10) AS shown FROM (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS tenths FROM orders)")
def printed_figures(spark, d):
    tenths = F.floor(c("o_totalprice") * 10) / 10
    return table(spark, d, "orders").select("o_orderkey", numbers.printed(F.when(c("o_orderkey") % 3 == 0, -tenths).otherwise(tenths), 1).alias("shown"))


_SPACE = "6ba7b8109dad11d180b400c04fd430c8"


@query(f"WITH h AS (SELECT part_id, sha1(from_hex('{_SPACE}') || encode(name)) AS h FROM (SELECT p_partkey AS part_id, p_name || ':' || p_partkey AS name FROM part)) SELECT part_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point FROM h")
def point_ids(spark, d):
    name = F.concat(c("p_name"), F.lit(":"), c("p_partkey").cast("string"))
    return table(spark, d, "part").select(c("p_partkey").alias("part_id"), numbers.uuid5(_SPACE, name).alias("point"))


@query("SELECT c_custkey, c_name, c_custkey % 2 = 0 OR c_custkey % 10 = 5 AS old FROM customer")
def insert_new_companies(spark, d):
    """Even customers are there; all are offered, some already there under another name. Every tenth odd one is there too."""
    x = table(spark, d, "customer").select("c_custkey", "c_name")
    old = x.where("c_custkey % 2 = 0 OR c_custkey % 10 = 5").withColumn("old", F.lit(True))
    return warehouse.insert_new(old, x.withColumn("old", F.lit(False)), ["c_custkey"])


_PAGES = """pa AS (SELECT doc_id AS page_key, n AS page_no, CASE WHEN n % 11 = 0 THEN 'Table of Contents' || chr(10) || line WHEN n % 7 = 1 THEN 'S.01.02 S.02.01 S.05.01 ' || line WHEN n % 5 = 2 THEN 'S.23.0' || n % 9 || ' ' || line WHEN n % 13 = 3 THEN 'a .... 3' || chr(10) || 'b ..... 17' || chr(10) || line ELSE line END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE trim(line) <> ''),
tr AS (SELECT *, CASE WHEN contains(lower(text), 'table of contents') OR len(list_filter(rows, lambda x: regexp_matches(x, '\\.{3,}\\s*\\d+\\s*$')))::DOUBLE / greatest(len(rows), 1) > 0.5 THEN 'contents' WHEN len(codes) >= 3 THEN 'index' WHEN len(codes) >= 1 THEN 'table' ELSE 'narrative' END AS kind FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS rows, list_distinct(regexp_extract_all(text, '[A-Z]\\.\\d{2}\\.\\d{2}')) AS codes FROM pa)),
tt AS (SELECT page_key, page_no, kind, CASE WHEN kind = 'table' THEN codes[1] END AS template, length(text)::INT AS n_chars, sum((kind <> 'narrative')::INT) OVER (PARTITION BY page_key ORDER BY page_no) AS brk FROM tr)"""


@query(f"WITH {_PAGES} SELECT page_key, page_no, kind, template, n_chars, first_value(template) OVER (PARTITION BY page_key, brk ORDER BY page_no) AS effective_template FROM tt")
def page_triage(spark, d):
    """Lines of documents as pages; some are contents, indexes or tables by their codes."""
    x = documents.lines(table(spark, d, "documents"))
    n = c("line_no")
    body = F.when(n % 11 == 0, F.concat(F.lit("Table of Contents\n"), "line")).when(n % 7 == 1, F.concat(F.lit("S.01.02 S.02.01 S.05.01 "), "line")).when(n % 5 == 2, F.concat(F.lit("S.23.0"), (n % 9).cast("string"), F.lit(" "), "line")).when(n % 13 == 3, F.concat(F.lit("a .... 3\nb ..... 17\n"), "line")).otherwise(c("line"))
    return documents.continued(documents.triage(x.select(c("doc_id").alias("page_key"), n.alias("page_no"), body.alias("text"))))
