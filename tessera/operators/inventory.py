"""What a report holds: annexes, templates and their pages, contents, sections, cover facts, and whether it may go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes of templates, of rows in them, and of sections.
TEMPLATE, ROW, SECTION = r"[A-Z]\.\d{2}\.\d{2}(?:\.\d{2})?", r"\bR\d{4}\b", r"[A-Z](?:\.\d+)+\.?|[A-Z]\."
#: Pages of more characters have their text; others are pictures of it.
NATIVE = 500
READY, CHECK = "ready", "to be checked by hand"


def annexes(pages: DataFrame, pattern: str = rf"(?i)annex\s+(\d+)\s*[:–-]\s*({TEMPLATE})") -> DataFrame:
    """(doc, annex, code): the code that each annex number stands for, by its last mention."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = pages.select("doc", "page_no", F.posexplode(found).alias("at", "m"))
    last = rows.groupBy("doc", F.regexp_extract("m", pattern, 1).cast("int").alias("annex")).agg(F.max(F.struct("page_no", "at", F.regexp_extract("m", pattern, 2).alias("code"))).alias("l"))
    return last.select("doc", "annex", "l.code")


def template_pages(pages: DataFrame) -> DataFrame:
    """(doc, page_no, template, place, n_chars): a row for each different code of a page, in order of first mention; the first has place 0."""
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(TEMPLATE), F.lit(0)))
    return pages.select("doc", "page_no", F.length("text").alias("n_chars"), F.posexplode(codes).alias("place", "template")).select("doc", "page_no", "template", "place", "n_chars")


def inventory(found: DataFrame) -> DataFrame:
    """(doc, template, pages, native, format): a template's pages and whether they have text, are pictures, or are mixed."""
    native = F.col("n_chars") > NATIVE
    form = F.when(F.bool_and(native), "native").when(F.bool_or(native), "mixed").otherwise("image")
    return found.groupBy("doc", "template").agg(F.count_distinct("page_no").alias("pages"), F.count_if(native).alias("native"), form.alias("format"))


def profiles(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, kind, method, mode): what a document's templates and texts tell.

    The last part of the first S.23.01 code tells solo (01) from group (22); S.25.01 is the standard formula, S.25.02 to 05
    an internal model; a row code anywhere on a page with a template means that tables are read by codes, else by labels."""
    c = F.col
    own = found.groupBy("doc").agg(F.min(F.when(c("template").startswith("S.23.01"), c("template"))).alias("_funds"), F.bool_or(c("template").startswith("S.25.01")).alias("_standard"), F.bool_or(c("template").rlike(r"^S\.25\.0[2-5]")).alias("_internal"))
    coded = pages.where(c("text").rlike(TEMPLATE)).groupBy("doc").agg(F.bool_or(c("text").rlike(ROW)).alias("_codes"))
    suffix = F.substring_index("_funds", ".", -1)
    kind = F.when(suffix == "22", "group").when(suffix == "01", "solo").otherwise("unknown")
    method = F.when(c("_standard"), "standard formula").when(c("_internal"), "internal model").otherwise("unknown")
    return own.join(coded, "doc").select("doc", kind.alias("kind"), method.alias("method"), F.when(c("_codes"), "codes").otherwise("labels").alias("mode"))


def conclusion(pages: DataFrame, anomalies: DataFrame, blocking: list[str]) -> DataFrame:
    """(doc, pages by kind, anomalies, blocking, conclusion): counts of pages (doc, kind) and of anomalies (doc, anomaly); one that blocks sends the document to be checked."""
    by = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_pages")
    counts = pages.groupBy("doc").agg(F.count("*").alias("pages"), by("narrative"), by("table"), by("contents"))
    bad = anomalies.groupBy("doc").agg(F.count("*").alias("anomalies"), F.count_if(F.col("anomaly").isin(*blocking)).alias("blocking"))
    j = counts.join(bad, "doc", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("anomalies", "blocking")})
    return j.withColumn("conclusion", F.when(F.col("blocking") > 0, CHECK).otherwise(READY))


def contents(lines: DataFrame, key: list[str], skip: str = r"(?i)^(?:contents|\d+)$") -> DataFrame:
    """(key, line_no, line) to (key, entry, section, title, page): the entries of a table of contents.

    An entry ends in a line with four or more dots and a page number; the lines before it, after the entry before, are
    the start of its title. The first of them that begins with a section code gives the code, unless the last line has
    one. What follows the last entry comes as one row without page."""
    line = F.trim("line")
    rows = lines.where((line != "") & ~line.rlike(skip)).select(*key, "line_no", line.alias("line"))
    entry = rf"^(?:({SECTION})\s+)?(.+?)\s*\.{{4,}}\s*(\d{{1,4}})\s*$"
    prefix = rf"^({SECTION})\s+(.+)$"
    w = Window.partitionBy(*key).orderBy("line_no")
    rows = rows.withColumn("_end", F.col("line").rlike(entry)).withColumn("entry", F.coalesce(F.sum(F.col("_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    coded = ~F.col("_end") & F.col("line").rlike(prefix)
    rows = rows.withColumn("_first", F.min(F.when(coded, F.col("line_no"))).over(Window.partitionBy(*key, "entry")))
    opens = F.col("line_no") == F.col("_first")
    part = F.when(F.col("_end"), F.regexp_extract("line", entry, 2)).when(F.coalesce(opens, F.lit(False)), F.regexp_extract("line", prefix, 2)).otherwise(F.col("line"))
    pick = lambda cond, x: F.max(F.when(cond, x))
    g = rows.groupBy(*key, "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", part.alias("p")))), lambda x: x["p"]), " ").alias("title"), pick(F.col("_end"), F.nullif(F.regexp_extract("line", entry, 1), F.lit(""))).alias("_own"), pick(opens, F.regexp_extract("line", prefix, 1)).alias("_pending"), pick(F.col("_end"), F.regexp_extract("line", entry, 3).cast("int")).alias("page"))
    return g.select(*key, "entry", F.coalesce("_own", "_pending").alias("section"), "title", "page")


def page_sections(pages: DataFrame) -> DataFrame:
    """(doc, page_no, section): the code of the last heading (# to ###) up to the end of a page; null before the first."""
    heads = F.regexp_extract_all("text", F.lit(rf"(?m)^#{{1,3}}\s*({SECTION})\s+.+?\s*$"), F.lit(1))
    last = F.try_element_at(heads, F.lit(-1))
    w = Window.partitionBy("doc").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumn("_h", last).select("doc", "page_no", F.last("_h", ignorenulls=True).over(w).alias("section"))


def cover_facts(pages: DataFrame, patterns: dict[str, str], first: int = 3) -> DataFrame:
    """(doc, one column a pattern): the first group of each pattern's first hit on the first pages; null without one."""
    near = pages.where(F.col("page_no") <= first)
    hit: dict[str, Column] = {n: F.min(F.when(F.col("text").rlike(p), F.struct("page_no", F.regexp_extract("text", p, 1).alias("v")))) for n, p in patterns.items()}
    return near.groupBy("doc").agg(*[x["v"].alias(n) for n, x in hit.items()])
