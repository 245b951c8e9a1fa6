"""Queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytebpe, codes, html, licenses, lines, media, merkle, minhash, mixing, packing, quality, tokens, vectors

#: Where the vocabulary files lie; empty: beside the package ``public_tokenizers``.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents"), least_words=lines.ALL)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    manifest = merkle.build(docs.withColumn("again", merkle.leaf_digest(text=tampered)), carry=("again",))
    digest = F.sha2(F.array_join(F.flatten(F.transform("proof", lambda step: step["siblings"])), ""), 256)
    out = merkle.proofs(manifest).withColumn("folded_root", merkle.folded(F.col("carried.again"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(_table(spark, sf_dir, "embeddings"))
    out = codes.with_label_error(found.codes)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    out = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def queries() -> dict:
    found = (op1_mixing, op2_lines, op3_licenses, op4_minhash, op5_token_counts, op6_html_text, op7_vectors, op8_packing, op9_quality, op10_media, op11_merkle, op12_codes, op13_byte_bpe)
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS k FROM documents),
t AS (SELECT source, sum(size)::DOUBLE AS words FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 3.0 * words AS most FROM t),
l AS (SELECT *, ((sum(words) OVER ()) - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, sid, words::BIGINT AS words, least(most, max(level) OVER () * w) AS target FROM l),
h AS (SELECT *, ceil(words / 4096.0)::BIGINT AS blocks, CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT ELSE 0 END AS need FROM g),
i AS (SELECT *, CASE WHEN words > 0 THEN need // words * blocks + ceil((need % words) / 4096.0)::BIGINT ELSE 0 END AS slots,
             CASE WHEN words > 0 THEN need % words ELSE 0 END AS rest FROM h),
s AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo, (sum(slots) OVER ())::BIGINT AS n FROM i),
-- van der Corput points through the cumulative shares: the counter's 40 bits, reversed
v AS (SELECT k AS slot, list_sum([((k >> j) & 1) << (39 - j) FOR j IN range(40)])::BIGINT AS x
      FROM (SELECT unnest(range((SELECT max(n) FROM s))) AS k)),
dealt AS (SELECT sid, slot, slots, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM v JOIN s
          ON x >= lo::DOUBLE / n * 1099511627776.0 AND x < (lo + slots)::DOUBLE / n * 1099511627776.0),
ranked AS (SELECT sid, rank, slot FROM dealt WHERE rank < slots
           UNION ALL
           SELECT sid, unnest(range(had, slots)) AS rank, n + lo + unnest(range(had, slots)) AS slot
           FROM (SELECT s.*, coalesce(c.had, 0)::BIGINT AS had FROM s LEFT JOIN (SELECT sid, count(*) AS had FROM dealt GROUP BY sid) c USING (sid)) WHERE had < slots),
takes AS (SELECT sid, rank % blocks AS block, count(*) FILTER (WHERE NOT last) AS whole, coalesce(max(rest - (rank % blocks) * 4096) FILTER (WHERE last), 0) AS part,
                 min(slot) FILTER (WHERE NOT last) AS whole_at, min(slot) FILTER (WHERE last) AS part_at
          FROM (SELECT ranked.*, blocks, rest, rank = slots - 1 AND rest > 0 AS last FROM ranked JOIN s USING (sid)) GROUP BY ALL),
p AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, s.sid, s.words AS source_size, s.target,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(pos // 4096, (pos + size - 1) // 4096 + 1) ELSE [-1] END) AS block FROM p),
took AS (SELECT pieces.*, whole, whole_at, part_at, least(pos + size, (block + 1) * 4096) - greatest(pos, block * 4096) AS here,
                greatest(0, least(pos + size, (block + 1) * 4096, block * 4096 + coalesce(part, 0)) - greatest(pos, block * 4096)) AS rest
         FROM pieces LEFT JOIN takes USING (sid, block))
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN size = 0 THEN 0 ELSE coalesce(whole, 0) * here + rest END)::BIGINT AS taken,
       min(CASE WHEN size > 0 THEN least(whole_at, CASE WHEN rest > 0 THEN part_at END) END)::BIGINT AS first_slot,
       sum(CASE WHEN size = 0 THEN 0 ELSE coalesce(whole, 0) + CASE WHEN rest > 0 THEN 1 ELSE 0 END END)::BIGINT AS n_slots
FROM took GROUP BY row, doc_id, size, source_size, target
"""


def _tree_levels(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs of a forest: {name}0.. with (tree, idx, n, digest), and {name}s0.. with each node's siblings before and after it."""
    found = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
        found.append(f"""{name}s{k} AS MATERIALIZED (SELECT tree, idx, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
        found.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx // 16 AS idx, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 16, (n + 15) // 16)")
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return [*found, f"{name}top AS MATERIALIZED ({tops})"]


def _climb(name: str, start: str, place: str, levels: int) -> list[str]:
    """CTEs that take rows (tree, {place}, proof, folded) of ``start`` up a forest's levels."""
    steps, before = [], start
    for k in range(levels):
        steps.append(f"{start}{name}{k} AS (SELECT p.* REPLACE (proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.l IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded) FROM {before} p LEFT JOIN {name}s{k} s ON s.tree = p.{name}_tree AND s.idx = p.{place} // {16**k})")
        before = f"{start}{name}{k}"
    return steps


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_CRC = "xor(list_reduce([ascii(c) FOR c IN string_split(doc_id::VARCHAR, '')], lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT)"
_LEAF = lambda text: "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
OP11_SQL = "WITH " + ",\n".join(
    [
        f"d AS MATERIALIZED (SELECT coalesce(':' || source, '') AS tree, doc_id, {_LEAF('text')} AS leaf, {_LEAF(f'CASE WHEN {_CRC} % 5 = 0 THEN translate(text, {UPPER!r}, {UPPER.lower()!r}) ELSE text END')} AS again FROM documents)",
        "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d)",
        *_tree_levels("a", "SELECT tree, idx, n, leaf AS digest FROM e", 7),
        "t AS MATERIALIZED (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM atop)",
        *_tree_levels("b", "SELECT '' AS tree, idx, n, digest FROM t", 4),
        "p AS (SELECT e.doc_id, e.leaf, t.digest AS subroot, btop.digest AS root, e.tree AS a_tree, e.idx AS a_idx, '' AS b_tree, t.idx AS b_idx, '' AS proof, e.again AS folded FROM e JOIN t ON t.name = e.tree CROSS JOIN btop)",
        *_climb("a", "p", "a_idx", 7),
        *[x.replace("FROM p p", "FROM pa6 p") for x in _climb("b", "p", "b_idx", 4)],
    ]
) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM pb3"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds, each over all parts."""
    found = [
        "kept AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * 4096)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS r(p))",
        f"book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {entries})",
    ]
    for k in range(rounds + 1):
        distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(part.v, b.v)])::BIGINT"
        found.append(f"near{k} AS MATERIALIZED (SELECT vec_id, label, p, v, m.e AS e, m.d AS d FROM (SELECT vec_id, any_value(label) AS label, part.p, any_value(part.v) AS v, min({{'d': {distance}, 'e': b.e}}) AS m FROM part JOIN book{k} b ON b.p = part.p GROUP BY vec_id, part.p))")
        if k < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            found.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(c.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT p, e, list({mean} ORDER BY j) AS v
  FROM (SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{k}) GROUP BY ALL) GROUP BY p, e) c ON c.p = b.p AND c.e = b.e)""")
    return f"""WITH {", ".join(found)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op11_merkle": OP11_SQL, "op12_codes": _codes_sql()}
