"""Queries on laid-out items of documents: headers, levels, chunks, cleaning and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import documents, structure
from tessera.plans.queries import c, query
from tessera.session import table

FOOTER = r"Annual report page \d+"


def items(spark, d) -> DataFrame:
    """Lines as items; every fourth a header: numbered, with bullets, of private use only, empty or a dash; footers and cut texts among the rest."""
    x = documents.lines(table(spark, d, "documents"))
    n, k = c("line_no"), c("doc_id")
    turn = (n / 4).cast("long") + k
    head = n % 4 == 0
    title = F.substring("line", 1, 30)
    text = F.when(turn % 9 == 0, F.concat(F.lit("A.1.2 "), title)).when(turn % 9 == 1, F.concat(F.lit(" "), title)).when(turn % 9 == 2, "").when(turn % 9 == 3, " ").when(turn % 9 == 4, "--").when(turn % 9 == 5, F.concat(F.lit("B. "), title)).when(turn % 9 == 6, F.concat(F.lit("▪"), title)).when(turn % 9 == 7, F.concat(F.lit("C.1.2.3.4.5.6.7 "), title)).otherwise(title)
    body = F.when(n % 5 == 1, F.concat(F.lit(" "), "line")).when(n % 7 == 3, F.concat("line", F.lit("\nAnnual report page 12\nand on"))).when(n % 11 == 6, F.substring("line", 1, 20)).otherwise(c("line"))
    return x.select(k.alias("doc"), n.alias("position"), F.when(head, "section_header").when(n % 3 == 0, "list_item").otherwise("text").alias("kind"), F.when(head, (n % 3 + 1).cast("int")).alias("level"), F.when(head, text).otherwise(body).alias("text"), (n / 6 + 1).cast("int").alias("page"), F.format_string("#/texts/%d", n).alias("self_ref"), c("line"))


def _prepared(spark, d) -> DataFrame:
    """Recovered, filtered, retyped, with levels."""
    raw = items(spark, d)
    full = raw.where("position % 11 = 6 AND kind <> 'section_header' AND position % 5 <> 1 AND position % 7 <> 3").select("doc", "self_ref", c("line").alias("full_text"))
    kept, _ = structure.filtered_headers(structure.recovered_texts(raw.drop("line"), full))
    return structure.corrected_levels(structure.retyped_bullets(kept))


_RAW = r"""r0 AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
r1 AS (SELECT *, n // 4 + doc AS turn, line[1:30] AS title FROM r0 WHERE trim(line) <> ''),
ra AS MATERIALIZED (SELECT doc, n AS position, CASE WHEN n % 4 = 0 THEN 'section_header' WHEN n % 3 = 0 THEN 'list_item' ELSE 'text' END AS kind, CASE WHEN n % 4 = 0 THEN (n % 3 + 1)::INT END AS level, (n // 6 + 1)::INT AS page,
  CASE WHEN n % 4 = 0 THEN CASE turn % 9 WHEN 0 THEN 'A.1.2 ' || title WHEN 1 THEN chr(61607) || ' ' || title WHEN 2 THEN chr(57354) || chr(63743) WHEN 3 THEN ' ' WHEN 4 THEN '--' WHEN 5 THEN 'B. ' || title WHEN 6 THEN '▪' || title WHEN 7 THEN 'C.1.2.3.4.5.6.7 ' || title ELSE title END
    WHEN n % 5 = 1 THEN chr(57345) || ' ' || line WHEN n % 7 = 3 THEN line || chr(10) || 'Annual report page 12' || chr(10) || 'and on' ELSE line END AS text FROM r1),
fa AS (SELECT *, CASE WHEN kind <> 'section_header' THEN NULL WHEN trim(text) = '' THEN 'empty' WHEN trim(regexp_replace(text, '[\x{E000}-\x{F8FF}]', '', 'g')) = '' THEN 'private use only' WHEN length(trim(regexp_replace(text, '[\x{E000}-\x{F8FF}]', '', 'g'))) <= 2 AND NOT regexp_matches(text, '[\pL\pN]') THEN 'short without letter or digit' END AS fault FROM ra),
bu AS (SELECT *, kind = 'section_header' AND regexp_matches(text, '^\s*[\x{E000}-\x{F8FF}\x{25AA}]+\s*') AS retyped FROM fa WHERE fault IS NULL),
rt AS (SELECT doc, position, page, retyped, CASE WHEN retyped THEN 'list_item' ELSE kind END AS kind, CASE WHEN NOT retyped THEN level END AS level, CASE WHEN retyped THEN regexp_replace(text, '^\s*[\x{E000}-\x{F8FF}\x{25AA}]+\s*', '') ELSE text END AS text FROM bu),
pr AS MATERIALIZED (SELECT * REPLACE (CASE WHEN kind = 'section_header' AND regexp_matches(text, '^\s*[A-Z](\.\d+)*\.?\s') AND regexp_matches(text, '^\s*[A-Z]\.') THEN least(len(regexp_extract_all(regexp_extract(text, '^\s*[A-Z]((\.\d+)*)\.?\s', 1), '\.')) + 1, 6)::INT ELSE level END AS level) FROM rt),
hd AS (SELECT *, max(CASE WHEN kind = 'section_header' THEN position END) OVER (PARTITION BY doc ORDER BY position) AS head FROM pr),
ch AS MATERIALIZED (SELECT doc, head AS position, any_value(text) FILTER (kind = 'section_header') AS title, any_value(level) FILTER (kind = 'section_header') AS level, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, coalesce(sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) FILTER (kind <> 'section_header'), 0)::BIGINT AS words,
  coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (kind <> 'section_header' AND text <> ''), '') AS text FROM hd WHERE head IS NOT NULL GROUP BY doc, head),
cl0 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(text, '[\x{E000}-\x{F8FF}] ?', '', 'g'), '([^.!?:;\n])\n+Annual report page \d+\n+', '\1 ', 'g'), '\n*Annual report page \d+(\n|$)', '\1', 'g') AS text) FROM ch),
cl AS (SELECT cl0.* REPLACE (len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS words), words AS words_before FROM cl0)"""
_CATEGORY = "CASE WHEN words >= 5 THEN 'indexable' ELSE 'structural' END AS category"


@query(f"WITH {_RAW} SELECT doc, position, fault FROM fa WHERE fault IS NOT NULL")
def header_removals(spark, d):
    return structure.filtered_headers(items(spark, d))[1].select("doc", "position", "fault")


@query(f"WITH {_RAW} SELECT doc, position, kind, level, md5(text) AS text, retyped FROM pr")
def prepared_items(spark, d):
    return _prepared(spark, d).select("doc", "position", "kind", "level", F.md5("text").alias("text"), "retyped")


@query(f"WITH {_RAW} SELECT doc, position, title, level, pages, words, md5(text) AS text, {_CATEGORY} FROM ch")
def direct_chunks(spark, d):
    return structure.direct_chunks(_prepared(spark, d)).withColumns({"pages": F.array_join("pages", ","), "text": F.md5("text")})


@query(f"WITH {_RAW} SELECT doc, position, words_before, words, md5(text) AS text, {_CATEGORY} FROM cl")
def cleaned_chunks(spark, d):
    return structure.cleaned(structure.direct_chunks(_prepared(spark, d)), FOOTER).select("doc", "position", "words_before", "words", F.md5("text").alias("text"), "category")


@query(f"WITH {_RAW} SELECT doc, position, lang, source, words FROM ch JOIN documents ON doc = doc_id WHERE words >= 5")
def chunks_with_metadata(spark, d):
    meta = table(spark, d, "documents").select(c("doc_id").alias("doc"), "lang", "source")
    return structure.with_metadata(structure.indexable(structure.direct_chunks(_prepared(spark, d))), meta).select("doc", "position", "lang", "source", "words")


@query(f"""WITH {_RAW}, lg AS (SELECT *, kind = 'section_header' AND lag(kind) OVER (PARTITION BY doc ORDER BY position) = 'section_header' AS after FROM pr)
SELECT 'kind' AS what, kind AS value, count(*) AS n FROM lg GROUP BY kind UNION ALL SELECT 'level', coalesce(level::VARCHAR, 'none'), count(*) FROM lg WHERE kind = 'section_header' GROUP BY level UNION ALL SELECT 'headers in a row', '', count(*) FROM lg WHERE after HAVING count(*) > 0""")
def item_counts(spark, d):
    return structure.item_counts(_prepared(spark, d))


@query(f"WITH {_RAW}, cg AS (SELECT *, {_CATEGORY} FROM ch) SELECT category, count(*) AS chunks, min(words) AS least, max(words) AS greatest, median(words) AS median, count(*) FILTER (words < 10) AS small FROM cg GROUP BY 1")
def chunk_statistics(spark, d):
    return structure.chunk_statistics(structure.direct_chunks(_prepared(spark, d)))


@query("SELECT '#/tables/' || vec_id AS self_ref, vec_id % 3 <> 0 AS has_text, vec_id % 5 <> 0 AS has_image, CASE WHEN vec_id % 5 = 0 THEN 'text only' WHEN vec_id % 3 = 0 THEN 'image only' ELSE 'both' END AS state FROM embeddings WHERE NOT (vec_id % 3 = 0 AND vec_id % 5 = 0)")
def dual_vector_points(spark, d):
    """Halves of embeddings as text and image vectors of tables; some lack one."""
    e = table(spark, d, "embeddings").select(F.format_string("#/tables/%d", c("vec_id")).alias("self_ref"), "vec_id", F.slice("embedding", 1, 32).alias("v_text"), F.slice("embedding", 33, 32).alias("v_image"))
    out = structure.dual_points(e.where("vec_id % 3 <> 0"), e.where("vec_id % 5 <> 0"))
    return out.select("self_ref", c("v_text").isNotNull().alias("has_text"), c("v_image").isNotNull().alias("has_image"), "state")
