"""Items of a laid-out report on their way to chunks: false headers, bullets, levels, recovered texts, direct chunks, cleaning with a recount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators.chunks import INDEXABLE
from tessera.operators.warehouse import require

#: Characters of private use, which fonts put bullets and signs in, and the bullet that has a code of its own.
PRIVATE, BULLET = r"[\x{E000}-\x{F8FF}]", r"^\s*[\x{E000}-\x{F8FF}\x{25AA}]+\s*"
#: Headers without letters or digits are false up to so many characters.
SHORT = 2


def header_faults(items: DataFrame) -> DataFrame:
    """Adds fault to items (doc, position, kind, level, text): why a header is none (empty, private use only, or short without letter or digit); null for good ones and other kinds."""
    text = F.coalesce("text", F.lit(""))
    clean = F.trim(F.regexp_replace(text, PRIVATE, ""))
    fault = F.when(F.trim(text) == "", "empty").when(clean == "", "private use only").when((F.length(clean) <= SHORT) & ~clean.rlike(r"[\p{L}\p{N}]"), "short without letter or digit")
    return items.withColumn("fault", F.when(F.col("kind") == "section_header", fault))


def filtered_headers(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items without false headers, and the journal of those removed."""
    told = header_faults(items)
    return told.where("fault IS NULL").drop("fault"), told.where("fault IS NOT NULL")


def retyped_bullets(items: DataFrame) -> DataFrame:
    """Headers that start with a bullet become list items without it and without level; retyped tells which."""
    bullet = (F.col("kind") == "section_header") & F.coalesce(F.col("text").rlike(BULLET), F.lit(False))
    level = F.when(~bullet, F.col("level"))
    return items.withColumns({"retyped": bullet, "kind": F.when(bullet, "list_item").otherwise(F.col("kind")), "level": level, "text": F.when(bullet, F.regexp_replace("text", BULLET, "")).otherwise(F.col("text"))})


def numbered_level(text: Column, deepest: int = 6) -> Column:
    """Level by a number in front, A. or D.1.6: one more than its dotted numbers; null without one."""
    numbers = F.regexp_extract(text, r"^\s*[A-Z]((?:\.\d+)*)\.?\s", 1)
    found = text.rlike(r"^\s*[A-Z](?:\.\d+)*\.?\s") & text.rlike(r"^\s*[A-Z]\.")
    return F.when(found, F.least(F.regexp_count(numbers, F.lit(r"\.")) + 1, F.lit(deepest)))


def corrected_levels(items: DataFrame) -> DataFrame:
    """Headers get the level that their number tells; those without keep theirs."""
    return items.withColumn("level", F.when(F.col("kind") == "section_header", F.coalesce(numbered_level(F.col("text")), "level")).otherwise(F.col("level")))


def recovered_texts(items: DataFrame, full: DataFrame) -> DataFrame:
    """Cut texts replaced by the whole ones of their reference (doc, self_ref, full_text); others stay."""
    return items.join(full, ["doc", "self_ref"], "left").withColumn("text", F.coalesce("full_text", "text")).drop("full_text")


def direct_chunks(items: DataFrame) -> DataFrame:
    """One chunk a header, of the items up to the next: doc, position, title, level, pages, words, text, category.

    Pages are the header's and the items'; a chunk of ``INDEXABLE`` words is indexable, others, and headers with nothing
    below them, are structural. What comes before the first header belongs to none."""
    w = Window.partitionBy("doc").orderBy("position")
    rows = items.withColumn("_head", F.max(F.when(F.col("kind") == "section_header", F.col("position"))).over(w)).where("_head IS NOT NULL")
    head = F.col("kind") == "section_header"
    body = F.transform(F.sort_array(F.collect_list(F.when(~head & (F.col("text") != ""), F.struct("position", "text")))), lambda x: x["text"])
    g = rows.groupBy("doc", F.col("_head").alias("position")).agg(F.max(F.when(head, F.struct("text", "level"))).alias("h"), F.array_sort(F.collect_set("page")).alias("pages"), F.coalesce(F.sum(F.when(~head, word_count(F.col("text")))), F.lit(0)).cast("long").alias("words"), F.array_join(body, "\n").alias("text"))
    category = F.when(F.col("words") >= INDEXABLE, "indexable").otherwise("structural")
    return g.select("doc", "position", F.col("h.text").alias("title"), F.col("h.level").alias("level"), "pages", "words", "text", category.alias("category"))


def indexable(chunks: DataFrame) -> DataFrame:
    return chunks.where("category = 'indexable'")


def cleaned(chunks: DataFrame, footer: str) -> DataFrame:
    """Chunks without characters of private use (and a space after them) and footers, words counted anew; words_before is the old number.

    A line that a footer cut in two is put together with a space where the first part has no end of a sentence."""
    plain = F.regexp_replace("text", PRIVATE + " ?", "")
    glued = F.regexp_replace(plain, rf"([^.!?:;\n])\n+{footer}\n+", "$1 ")
    bare = F.regexp_replace(glued, rf"\n*{footer}(?=\n|$)", "")
    out = chunks.withColumn("words_before", F.col("words")).withColumn("text", bare)
    out = out.withColumn("words", word_count(F.col("text")).cast("long"))
    return out.withColumn("category", F.when(F.col("words") >= INDEXABLE, "indexable").otherwise("structural"))


def with_metadata(chunks: DataFrame, metadata: DataFrame, key: str = "doc") -> DataFrame:
    """Chunks with their document's metadata (one row a key); an error if a document has none, so that nothing half done is written."""
    missing = chunks.select(key).distinct().join(metadata, key, "left_anti")
    return require(chunks, missing.limit(1), "a document has no metadata").join(metadata, key)


def item_counts(items: DataFrame) -> DataFrame:
    """(what, value, n): items by kind, headers by level, and headers right after a header."""
    w = Window.partitionBy("doc").orderBy("position")
    rows = items.withColumn("_after", (F.col("kind") == "section_header") & (F.lag("kind").over(w) == "section_header"))
    head = F.col("kind") == "section_header"
    told = F.array_compact(F.array(F.struct(F.lit("kind").alias("what"), F.col("kind").alias("value")), F.when(head, F.struct(F.lit("level").alias("what"), F.coalesce(F.col("level").cast("string"), F.lit("none")).alias("value"))), F.when(F.col("_after"), F.struct(F.lit("headers in a row").alias("what"), F.lit("").alias("value")))))
    return rows.select(F.explode(told).alias("t")).groupBy("t.what", "t.value").agg(F.count("*").alias("n"))


def chunk_statistics(chunks: DataFrame, small: int = 10) -> DataFrame:
    """One row a category: chunks, least, greatest and median words, and how many have fewer than ``small``."""
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"), F.min("words").alias("least"), F.max("words").alias("greatest"), F.median("words").alias("median"), F.count_if(F.col("words") < small).alias("small"))


def dual_points(texts: DataFrame, images: DataFrame, key: str = "self_ref") -> DataFrame:
    """Points with both vectors, and the remainders of either side: key, v_text, v_image and state (both, text only, image only)."""
    j = texts.select(key, "v_text").join(images.select(key, "v_image"), key, "full")
    state = F.when(F.col("v_image").isNull(), "text only").when(F.col("v_text").isNull(), "image only").otherwise("both")
    return j.withColumn("state", state)
