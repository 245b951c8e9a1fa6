"""Chunks of a section's items: units that belong together, splits that lose no word, list items that may be titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import greedy_groups
from tessera.operators.warehouse import require

#: Words from which a chunk is worth indexing.
INDEXABLE = 5


def units(items: DataFrame, key: list[str]) -> DataFrame:
    """(key, position, kind, text) with unit, from 1 on: an item that ends in a colon takes all list items right after it along.

    A run is an item that is no list item and the list items after it; in a run, whatever follows the first colon
    belongs to the unit of the item that has it, so units are a running sum over runs."""
    w = Window.partitionBy(*key).orderBy("position")
    listed = F.col("kind") == "list_item"
    rows = items.withColumn("_run", F.sum((~listed).cast("int")).over(w))
    colon = F.max(F.rtrim("text").endswith(":")).over(Window.partitionBy(*key, "_run").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_start", (~(listed & F.coalesce(colon, F.lit(False)))).cast("int"))
    return rows.withColumn("unit", F.sum("_start").over(w)).drop("_run", "_start")


def _assembled(rows: DataFrame, key: list[str]) -> DataFrame:
    """Text by position, words, pages and whether it is worth indexing, one row a key."""
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("position", "text")))), lambda x: x["text"])
    g = rows.groupBy(*key).agg(F.array_join(parts, "\n").alias("text"), F.sum("words").cast("long").alias("words"), F.array_sort(F.collect_set("page")).alias("pages"), F.min("position").alias("first"))
    return g.withColumn("indexable", F.col("words") >= INDEXABLE)


def split_paragraphs(items: DataFrame, key: list[str], least: int = 400, most: int = 500) -> DataFrame:
    """(key, position, kind, text, words, page) to chunks (key, chunk, text, words, pages, first, indexable) of whole units.

    A chunk closes when it has ``least`` words and the next unit would take it past ``most``."""
    cut = units(items, key)
    sums = cut.groupBy(*key, "unit").agg(F.sum("words").alias("words"))
    groups = greedy_groups(sums, key, "unit", "words", least, most).select(*key, F.col("group").alias("chunk"), F.explode(F.sequence("first", "last")).alias("unit"))
    return _assembled(cut.join(groups, [*key, "unit"]), [*key, "chunk"])


def split_at_titles(items: DataFrame, key: list[str], is_title: str = "is_title") -> DataFrame:
    """Chunks (key, chunk, title, title_words, text, words, pages, first, indexable): what comes before the first title, if anything, then one a title.

    A title's words leave the text and count as title_words."""
    w = Window.partitionBy(*key).orderBy("position")
    rows = items.withColumn("chunk", F.sum(F.col(is_title).cast("int")).over(w))
    heads = rows.where(is_title).select(*key, "chunk", F.col("text").alias("title"), F.col("words").cast("long").alias("title_words"), F.col("page").alias("_page"), F.col("position").alias("_first"))
    body = _assembled(rows.where(~F.col(is_title)), [*key, "chunk"])
    both = heads.join(body, [*key, "chunk"], "full")
    pages = F.array_sort(F.array_union(F.coalesce("pages", F.expr("array()").cast("array<int>")), F.coalesce(F.array_compact(F.array("_page")), F.expr("array()").cast("array<int>"))))
    return both.select(*key, "chunk", "title", F.coalesce("title_words", F.lit(0)).alias("title_words"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("words", F.lit(0)).alias("words"), pages.alias("pages"), F.coalesce("_first", "first").alias("first"), F.coalesce("indexable", F.lit(False)).alias("indexable"))


def lost_words(items: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, words_in, words_out) of the parents whose chunks hold other numbers of words than their items."""
    title = F.col("title_words") if "title_words" in chunks.columns else F.lit(0)
    out = chunks.groupBy(*key).agg(F.sum(F.col("words") + title).alias("words_out"))
    into = items.groupBy(*key).agg(F.sum("words").cast("long").alias("words_in"))
    return into.join(out, key, "full").where(~F.col("words_in").eqNullSafe(F.col("words_out")))


def conserved(items: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """The chunks, unless a parent lost or gained words: then an error, and nothing is to be written."""
    return require(chunks, lost_words(items, chunks, key).limit(1), "a split lost or gained words")


def list_item_classes(items: DataFrame, key: list[str], retyped: str = "retyped") -> DataFrame:
    """List items with class: detail if the item before ends in a colon, else candidate for a title if it was one once, else ambiguous."""
    before = F.lag("text").over(Window.partitionBy(*key).orderBy("position"))
    kind = F.when(F.coalesce(F.rtrim(F.col("_before")).endswith(":"), F.lit(False)), "detail").when(F.col(retyped), "candidate").otherwise("ambiguous")
    return items.withColumn("_before", before).where("kind = 'list_item'").withColumn("class", kind).drop("_before")
