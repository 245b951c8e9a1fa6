"""Markers in a text and the visuals they stand for, both ways, and the context of a search's winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A marker: kind and reference. Legends have markers too, but no visual.
MARKER = r"\[(TABLE|IMAGE): ([^\]\s]+)\]"
#: References of this form lead to a file.
REFERENCE = r"^#/(tables|pictures)/(\d+)$"


def marked(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path, text) to one row a marker: place from 0 on, kind, ref, and the text between the marker before and it, trimmed."""
    found = F.regexp_extract_all("text", F.lit(MARKER), F.lit(0))
    rows = chunks.select("chunk_id", "path", F.split("text", MARKER).alias("_between"), F.posexplode(found).alias("place", "m"))
    between = F.regexp_replace(F.get("_between", F.col("place")), r"^\s+|\s+$", "")
    return rows.select("chunk_id", "path", "place", F.regexp_extract("m", MARKER, 1).alias("kind"), F.regexp_extract("m", MARKER, 2).alias("ref"), between.alias("paragraph"))


def canonical(marks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds canonical, what a reference is an alias of (aliases: ref, target), and file; null for a reference of another form."""
    j = marks.join(aliases.select("ref", F.col("target").alias("_t")), "ref", "left").withColumn("canonical", F.coalesce("_t", "ref")).drop("_t")
    number = F.regexp_extract("canonical", REFERENCE, 2)
    return j.withColumn("file", F.when(F.col("canonical").rlike(REFERENCE), F.concat(F.regexp_extract("canonical", REFERENCE, 1), F.lit("/"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number), F.lit(".png"))))


def visuals_of_chunks(marks: DataFrame, most: int = 3) -> DataFrame:
    """(chunk_id, rank, kind, ref, canonical, file): the first ``most`` different visuals of each chunk by place; unknown forms don't count."""
    first = marks.where("file IS NOT NULL").groupBy("chunk_id", "canonical").agg(F.min(F.struct("place", "kind", "ref", "file")).alias("f")).select("chunk_id", "canonical", "f.*")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy("place"))).where(F.col("rank") <= most)
    return ranked.select("chunk_id", "rank", F.lower("kind").alias("kind"), "ref", "canonical", "file")


def places_of_visuals(visuals: DataFrame, marks: DataFrame) -> DataFrame:
    """(canonical) to status, path, chunk_id, paragraph: a visual whose markers all lie under one path has that path and the
    paragraph before its first marker; under several it is ambiguous, under none absent, and either way none is chosen."""
    per = marks.groupBy("canonical").agg(F.count_distinct("path").alias("n"), F.min(F.struct("chunk_id", "place", "path", "paragraph")).alias("f"))
    j = visuals.join(per, "canonical", "left")
    one = F.col("n") == 1
    pick = lambda x: F.when(one, F.col(f"f.{x}")).alias(x)
    status = F.when(F.col("n").isNull(), "absent").when(one, "unique").otherwise("ambiguous")
    return j.select("canonical", status.alias("status"), pick("path"), pick("chunk_id"), pick("paragraph"))


def contexts(winners: DataFrame, chunks: DataFrame, marks: DataFrame, visuals: DataFrame) -> DataFrame:
    """(query_id, kind, id) to one text a query: the winner's own, then what it leads to.

    A text (kind text, id chunk_id) comes with its visuals' files; a visual (id canonical) with its only paragraph, if it has one."""
    files = visuals_of_chunks(marks).groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ref", "file"))), lambda v: F.concat(F.lit("[VISUAL "), v["ref"], F.lit("] "), v["file"])), "\n").alias("linked"))
    texts = winners.where("kind = 'text'").join(chunks.select(F.col("chunk_id").cast("string").alias("id"), "chunk_id", "text"), "id").join(files, "chunk_id", "left")
    texts = texts.select("query_id", F.concat_ws("\n", F.concat(F.lit("[WINNER text]\n"), F.col("text")), F.col("linked")).alias("context"))
    places = places_of_visuals(visuals, marks).withColumnRenamed("canonical", "id")
    shown = winners.where("kind <> 'text'").join(places, "id", "left")
    paragraph = F.when(F.col("status") == "unique", F.concat(F.lit("[PARAGRAPH "), F.col("path"), F.lit("]\n"), F.col("paragraph")))
    shown = shown.select("query_id", F.concat_ws("\n", F.concat(F.lit("[WINNER "), F.col("kind"), F.lit("] "), F.col("id")), paragraph).alias("context"))
    return texts.unionByName(shown)
