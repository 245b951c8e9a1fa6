"""Operators on pages, lines, chunks and visuals of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators.components import components


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, line_no, line), blank lines left out."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def triage(pages: DataFrame, code: str = r"[A-Z]\.\d{2}\.\d{2}") -> DataFrame:
    """(page_key, page_no, text) to a kind by precedence: contents (word or dot leaders), index (three codes or more), table (a code), narrative."""
    rows = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    leaders = F.size(F.filter(rows, lambda x: x.rlike(r"\.{3,}\s*\d+\s*$"))) / F.greatest(F.size(rows), F.lit(1))
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(code), F.lit(0)))
    kind = F.when(F.lower("text").contains("table of contents") | (leaders > 0.5), "contents").when(F.size(codes) >= 3, "index").when(F.size(codes) >= 1, "table").otherwise("narrative")
    return pages.select("page_key", "page_no", kind.alias("kind"), F.when(kind == "table", codes[0]).alias("template"), F.length("text").alias("n_chars"))


def continued(found: DataFrame) -> DataFrame:
    """Narrative pages right after a table page carry its template on, until a page of another kind."""
    w = Window.partitionBy("page_key").orderBy("page_no")
    run = found.withColumn("_break", F.sum(F.when(F.col("kind") != "narrative", 1).otherwise(0)).over(w))
    first = F.first("template").over(Window.partitionBy("page_key", "_break").orderBy("page_no"))
    return run.withColumn("effective_template", first).drop("_break")


def chunk_anomalies(chunks: DataFrame, short: int = 30, long: int = 700) -> DataFrame:
    """(doc_id, chunk, text, pages): flags for short, long, cut off, residual private-use characters, repeats and page jumps."""
    words = word_count(F.col("text"))
    jump = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("pages") - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at("pages", i + 1) - F.try_element_at("pages", i), F.lit(0))))
    # counted by hash and joined, so that texts that many chunks have don't meet in one window
    hashed = chunks.withColumns({"_h": F.xxhash64("text"), "_g": F.xxhash64(F.lit(1), "text")})
    often = hashed.groupBy("_h", "_g").agg(F.count("*").alias("_n")).where("_n > 1")
    repeats = F.col("_n").isNotNull()
    return hashed.join(often, ["_h", "_g"], "left").select("doc_id", "chunk", words.alias("words"), (words < short).alias("is_short"), (words > long).alias("is_long"), (~F.col("text").rlike(r"[.!?:;|)]\s*$")).alias("cut_off"), F.col("text").rlike(r"[\x{E000}-\x{F8FF}]").alias("private_use"), repeats.alias("repeated"), (jump > 3).alias("page_jump"))


def found_codes(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(sheet, page_no, codes) runs of neighbouring pages merged; codes found, missing and unexpected against the sheet's."""
    w = Window.partitionBy("sheet").orderBy("page_no")
    run = pages.withColumn("run", F.col("page_no") - F.row_number().over(w))
    merged = run.groupBy("sheet", "run").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("found"))
    j = merged.join(expected, "sheet")
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return j.select("sheet", "first_page", "last_page", text(F.col("found")).alias("found"), text(F.array_except("expected", "found")).alias("missing"), text(F.array_except("found", "expected")).alias("unexpected"))


def column_gaps(cells: DataFrame) -> DataFrame:
    """(row_key, col_no, value): empty columns between filled ones of a row that has two filled at least."""
    w = Window.partitionBy("row_key")
    filled = F.when(F.col("value").isNotNull(), F.col("col_no"))
    df = cells.withColumns({"_a": F.min(filled).over(w), "_b": F.max(filled).over(w), "_n": F.count("value").over(w)})
    return df.where(F.col("value").isNull() & (F.col("_n") >= 2) & F.col("col_no").between(F.col("_a"), F.col("_b"))).select("row_key", "col_no")


def hamming_clusters(hashes: DataFrame, most: int, bits: int = 64) -> DataFrame:
    """(ref, phash long) to (ref, canonical): groups of pictures within ``most`` bits, by chains; the least ref stands for each.

    Of ``most`` + 2 bands two hashes within ``most`` bits share two at least, so pairs of bands find all pairs, and a
    bucket of two bands holds few that don't belong; equal hashes are one node. A null hash is alone. Joins
    are merges: broadcasts would lay hashes and edges in the driver."""
    nodes = hashes.where("phash IS NOT NULL").groupBy("phash").agg(F.min("ref").alias("node"))
    count = most + 2
    cuts = [bits * i // count for i in range(count + 1)]
    part = lambda i: F.shiftrightunsigned(F.col("phash"), cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1)
    bands = F.explode(F.array(*[F.struct(F.lit(i * count + j).alias("band"), part(i).alias("a"), part(j).alias("b")) for i in range(count) for j in range(i + 1, count)]))
    keyed = nodes.select("node", "phash", bands.alias("k")).select("node", "phash", "k.*")
    x, y = keyed.alias("x"), keyed.alias("y")
    near = F.bit_count(F.col("x.phash").bitwiseXOR(F.col("y.phash"))) <= most
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.node") < F.col("y.node"))
    edges = x.join(y.hint("merge"), same & near).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    found = nodes.join(components(edges).hint("merge"), "node", "left").select("phash", F.coalesce("component", "node").alias("canonical"))
    return hashes.join(found.hint("merge"), "phash", "left").select("ref", F.coalesce("canonical", "ref").alias("canonical"))
