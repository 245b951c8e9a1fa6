"""Queries on chunks of documents and on the visuals their texts mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators import chunks, documents, visuals
from tessera.plans.queries import c, query
from tessera.session import table

KEY = ["doc_id", "section"]


def items(spark, d) -> DataFrame:
    """Lines as items: some list items, some ending in a colon, some once titles; forty places are a section."""
    x = documents.lines(table(spark, d, "documents"))
    n = c("line_no")
    line = F.when((n + c("doc_id")) % 5 == 0, F.concat("line", F.lit(": "))).otherwise(c("line"))
    kind = F.when(n % 4 < 2, "text").otherwise("list_item")
    rows = x.select("doc_id", F.floor(n / 40).alias("section"), n.alias("position"), kind.alias("kind"), line.alias("text"), (n / 3 + 1).cast("int").alias("page"))
    return rows.withColumn("words", word_count(c("text"))).withColumn("retyped", (c("kind") == "list_item") & (c("position") % 7 == 2))


_ITEMS = r"""it AS MATERIALIZED (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, kind = 'list_item' AND position % 7 = 2 AS retyped FROM (
  SELECT doc_id, n // 40 AS section, n AS position, CASE WHEN n % 4 < 2 THEN 'text' ELSE 'list_item' END AS kind, CASE WHEN (n + doc_id) % 5 = 0 THEN line || ': ' ELSE line END AS text, (n // 3 + 1)::INT AS page
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE trim(line) <> '')),
ru AS (SELECT *, sum((kind <> 'list_item')::INT) OVER (PARTITION BY doc_id, section ORDER BY position) AS run FROM it),
st AS (SELECT *, NOT (kind = 'list_item' AND coalesce(max((rtrim(text) LIKE '%:')::INT) OVER (PARTITION BY doc_id, section, run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS start FROM ru),
un AS MATERIALIZED (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id, section ORDER BY position) AS unit FROM st)"""


@query(f"WITH {_ITEMS} SELECT doc_id, section, unit::BIGINT AS unit, count(*) AS n, min(position) AS first, sum(words)::BIGINT AS words FROM un GROUP BY ALL")
def atomic_units(spark, d):
    x = chunks.units(items(spark, d), KEY)
    return x.groupBy(*KEY, "unit").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.sum("words").cast("long").alias("words"))


@query(f"""WITH RECURSIVE {_ITEMS}, us AS MATERIALIZED (SELECT doc_id, section, unit, sum(words) AS words FROM un GROUP BY ALL),
gr AS (SELECT doc_id, section, unit, 0 AS chunk, words AS total FROM us WHERE unit = 1 UNION ALL
  SELECT us.doc_id, us.section, us.unit, CASE WHEN total >= 400 AND total + words > 500 THEN chunk + 1 ELSE chunk END, CASE WHEN total >= 400 AND total + words > 500 THEN words ELSE total + words END FROM gr JOIN us ON us.doc_id = gr.doc_id AND us.section = gr.section AND us.unit = gr.unit + 1)
SELECT doc_id, section, chunk, md5(string_agg(text, chr(10) ORDER BY position)) AS text, sum(words)::BIGINT AS words, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, min(position) AS first, sum(words) >= 5 AS indexable FROM un JOIN gr USING (doc_id, section, unit) GROUP BY ALL""")
def paragraph_chunks(spark, d):
    x = chunks.split_paragraphs(items(spark, d), KEY)
    return x.withColumns({"text": F.md5("text"), "pages": F.array_join("pages", ",")})


@query(f"""WITH {_ITEMS}, sg AS (SELECT *, sum(retyped::INT) OVER (PARTITION BY doc_id, section ORDER BY position) AS chunk FROM it)
SELECT doc_id, section, chunk::BIGINT AS chunk, any_value(text) FILTER (retyped) AS title, coalesce(sum(words) FILTER (retyped), 0)::BIGINT AS title_words, md5(coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (NOT retyped), '')) AS text, coalesce(sum(words) FILTER (NOT retyped), 0)::BIGINT AS words,
  array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, min(position) AS first, coalesce(sum(words) FILTER (NOT retyped), 0) >= 5 AS indexable FROM sg GROUP BY ALL""")
def titled_chunks(spark, d):
    x = chunks.split_at_titles(items(spark, d), KEY, "retyped")
    return x.withColumns({"text": F.md5("text"), "pages": F.array_join("pages", ",")})


@query(f"WITH {_ITEMS} SELECT doc_id, section, sum(words)::BIGINT AS words_in, sum(words)::BIGINT AS in_paragraphs, sum(words)::BIGINT AS in_titled, true AS kept FROM it GROUP BY ALL")
def words_kept_by_splits(spark, d):
    """Words of each section, and those in its chunks after a split of either kind, titles included."""
    x = items(spark, d)
    out = lambda df, words, name: df.groupBy(*KEY).agg(F.sum(words).cast("long").alias(name))
    titled, plain = chunks.split_at_titles(x, KEY, "retyped"), chunks.split_paragraphs(x, KEY)
    j = out(x, "words", "words_in").join(out(plain, "words", "in_paragraphs"), KEY, "full").join(out(titled, c("words") + c("title_words"), "in_titled"), KEY, "full")
    return j.withColumn("kept", (c("words_in") == c("in_paragraphs")) & (c("words_in") == c("in_titled")))


@query(f"WITH {_ITEMS}, pv AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, section ORDER BY position) AS before FROM it) SELECT doc_id, position, CASE WHEN rtrim(before) LIKE '%:' THEN 'detail' WHEN retyped THEN 'candidate' ELSE 'ambiguous' END AS class FROM pv WHERE kind = 'list_item'")
def list_item_classes(spark, d):
    return chunks.list_item_classes(items(spark, d), KEY).select("doc_id", "position", "class")


# --- visuals ------------------------------------------------------------------------------------------------------------


def _chunks(spark, d) -> DataFrame:
    """Ten lines are a chunk; every fifth line is followed by a marker, some of them of a legend or of a form that leads nowhere."""
    x = documents.lines(table(spark, d, "documents"))
    n, k = c("line_no"), c("doc_id")
    number = F.when(n % 4 == 2, F.floor(k / 2) * 10 + n % 10).otherwise(k * 100 + n % 20)
    ref = F.when(n % 35 == 2, F.format_string("#/other/%d", number)).otherwise(F.format_string("#/%s/%d", F.when(n % 2 == 0, "tables").otherwise("pictures"), number))
    kind = F.when(n % 25 == 7, "LEGEND").when(n % 2 == 0, "TABLE").otherwise("IMAGE")
    line = F.when(n % 5 == 2, F.concat("line", F.lit(" ["), kind, F.lit(": "), ref, F.lit("]"))).otherwise(c("line"))
    rows = x.select("doc_id", F.floor(n / 10).alias("part"), n.alias("n"), line.alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda y: y["line"]), "\n")
    g = rows.groupBy("doc_id", "part").agg(text.alias("text"))
    return g.select((c("doc_id") * 10000 + c("part")).alias("chunk_id"), F.format_string("report %d > part %d", c("doc_id"), F.floor(c("part") / 2)).alias("path"), "text")


def _aliases(spark, d) -> DataFrame:
    """A document's ninth picture is the copy of its first."""
    k = table(spark, d, "documents").select("doc_id").distinct()
    return k.select(F.format_string("#/pictures/%d", c("doc_id") * 100 + 17).alias("ref"), F.format_string("#/pictures/%d", c("doc_id") * 100 + 7).alias("target"))


def _marks(spark, d) -> DataFrame:
    return visuals.canonical(visuals.marked(_chunks(spark, d)), _aliases(spark, d))


def _visuals(spark, d) -> DataFrame:
    """Two pictures and a table of each document, whether its text marks them or not."""
    k = table(spark, d, "documents").select("doc_id").distinct()
    named = F.explode(F.array(F.format_string("#/pictures/%d", c("doc_id") * 100 + 7), F.format_string("#/tables/%d", c("doc_id") * 100 + 12), F.format_string("#/tables/%d", F.floor(c("doc_id") / 2) * 10 + 2)))
    return k.select(named.alias("canonical")).distinct()


_CHUNKS = r"""sl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
sm AS (SELECT doc_id, n, CASE WHEN n % 5 = 2 THEN line || ' [' || CASE WHEN n % 25 = 7 THEN 'LEGEND' WHEN n % 2 = 0 THEN 'TABLE' ELSE 'IMAGE' END || ': #/' || CASE WHEN n % 35 = 2 THEN 'other' WHEN n % 2 = 0 THEN 'tables' ELSE 'pictures' END || '/' || CASE WHEN n % 4 = 2 THEN doc_id // 2 * 10 + n % 10 ELSE doc_id * 100 + n % 20 END || ']' ELSE line END AS line FROM sl WHERE trim(line) <> ''),
ck AS (SELECT doc_id * 10000 + n // 10 AS chunk_id, 'report ' || doc_id || ' > part ' || n // 20 AS path, string_agg(line, chr(10) ORDER BY n) AS text FROM sm GROUP BY doc_id, n // 10, n // 20),
cm AS (SELECT chunk_id, path, unnest(regexp_extract_all(text, '\[(TABLE|IMAGE): ([^\]\s]+)\]', 1)) AS kind, unnest(regexp_extract_all(text, '\[(TABLE|IMAGE): ([^\]\s]+)\]', 2)) AS ref, unnest(string_split_regex(text, '\[(TABLE|IMAGE): ([^\]\s]+)\]')[:len(regexp_extract_all(text, '\[(TABLE|IMAGE): ([^\]\s]+)\]'))]) AS paragraph,
  unnest(range(len(regexp_extract_all(text, '\[(TABLE|IMAGE): ([^\]\s]+)\]')))) AS place FROM ck),
al AS (SELECT DISTINCT '#/pictures/' || (doc_id * 100 + 17) AS ref, '#/pictures/' || (doc_id * 100 + 7) AS target FROM documents),
mk AS MATERIALIZED (SELECT cm.* REPLACE (regexp_replace(paragraph, '^\s+|\s+$', '', 'g') AS paragraph), coalesce(target, cm.ref) AS canonical FROM cm LEFT JOIN al USING (ref)),
mf AS (SELECT *, CASE WHEN regexp_matches(canonical, '^#/(tables|pictures)/\d+$') THEN regexp_extract(canonical, '^#/(\w+)/(\d+)$', 1) || '/' || CASE WHEN length(regexp_extract(canonical, '\d+$')) < 5 THEN lpad(regexp_extract(canonical, '\d+$'), 5, '0') ELSE regexp_extract(canonical, '\d+$') END || '.png' END AS file FROM mk),
ff AS (SELECT * FROM mf WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, canonical ORDER BY place) = 1),
vc AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY place) AS rank, lower(kind) AS kind, ref, canonical, file FROM ff QUALIFY rank <= 3),
vs AS (SELECT DISTINCT canonical FROM (SELECT '#/pictures/' || (doc_id * 100 + 7) AS canonical FROM documents UNION ALL SELECT '#/tables/' || (doc_id * 100 + 12) FROM documents UNION ALL SELECT '#/tables/' || (doc_id // 2 * 10 + 2) FROM documents)),
pv AS (SELECT canonical, count(DISTINCT path) AS n, arg_min({'c': chunk_id, 'p': path, 't': paragraph}, (chunk_id, place)) AS f FROM mk GROUP BY 1),
pl AS (SELECT canonical, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN f.p END AS path, CASE WHEN n = 1 THEN f.c END AS chunk_id, CASE WHEN n = 1 THEN f.t END AS paragraph FROM vs LEFT JOIN pv USING (canonical))"""


@query(f"WITH {_CHUNKS} SELECT * FROM vc")
def visuals_of_chunks(spark, d):
    return visuals.visuals_of_chunks(_marks(spark, d))


@query(f"WITH {_CHUNKS} SELECT canonical, status, path, chunk_id, md5(paragraph) AS paragraph FROM pl")
def places_of_visuals(spark, d):
    return visuals.places_of_visuals(_visuals(spark, d), _marks(spark, d)).withColumn("paragraph", F.md5("paragraph"))


@query(f"""WITH {_CHUNKS}, li AS (SELECT chunk_id, string_agg('[VISUAL ' || ref || '] ' || file, chr(10) ORDER BY rank) AS linked FROM vc GROUP BY 1)
SELECT 't' || ck.chunk_id AS query_id, md5(concat_ws(chr(10), '[WINNER text]' || chr(10) || text, linked)) AS context FROM ck LEFT JOIN li USING (chunk_id) WHERE ck.chunk_id % 10000 = 0
UNION ALL SELECT 'v' || canonical, md5(concat_ws(chr(10), '[WINNER visual] ' || canonical, CASE WHEN status = 'unique' THEN '[PARAGRAPH ' || path || ']' || chr(10) || paragraph END)) FROM pl""")
def winner_contexts(spark, d):
    """A document's first chunk and every visual win a question each."""
    x, v = _chunks(spark, d), _visuals(spark, d)
    won = x.where("chunk_id % 10000 = 0").select(F.concat(F.lit("t"), "chunk_id").alias("query_id"), F.lit("text").alias("kind"), c("chunk_id").cast("string").alias("id"))
    won = won.unionByName(v.select(F.concat(F.lit("v"), "canonical").alias("query_id"), F.lit("visual").alias("kind"), c("canonical").alias("id")))
    return visuals.contexts(won, x, _marks(spark, d), v).withColumn("context", F.md5("context"))
