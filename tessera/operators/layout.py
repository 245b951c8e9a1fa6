"""Words and figures on a page: fragments put together, figures near a label or a code, articles cut at their markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_fragments(words: DataFrame, line: list[str], gap: float) -> DataFrame:
    """(line, x0, x1, text): neighbours on a line no more than ``gap`` apart become one text with its centre."""
    w = Window.partitionBy(*line).orderBy("x0", "x1", "text")
    new = F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap, F.lit(True)).cast("int")
    runs = words.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy(*line, "_run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), "").alias("text"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    return g.select(*line, "text", ((F.col("left") + F.col("right")) / 2).alias("centre"))


def nearest_right(codes: DataFrame, numbers: DataFrame, page: list[str], band: float) -> DataFrame:
    """For each code (cx, cy) the nearest number on its line, at most ``band`` above or below, to its right. Buckets of y bound the join."""
    at = lambda y: F.floor(y / band)
    a = codes.select(*page, "code", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(F.array(at(F.col("cy")) - 1, at(F.col("cy")), at(F.col("cy")) + 1)).alias("_b"))
    met = a.join(numbers.withColumn("_b", at(F.col("cy"))), [*page, "_b"]).where((F.abs(F.col("cy") - F.col("ay")) <= band) & (F.col("cx") > F.col("ax")))
    return met.groupBy(*page, "code", "ax", "ay").agg(F.min(F.struct("cx", "cy", "value")).alias("m")).select(*page, "code", "ax", "ay", "m.value")


def nearest_below(labels: DataFrame, numbers: DataFrame, page: list[str], reach: float) -> DataFrame:
    """For each label the number strictly below it and within ``reach`` down and aside that is nearest by squared distance."""
    at = lambda y: F.floor(y / reach)
    a = labels.select(*page, "label", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(F.array(at(F.col("cy")), at(F.col("cy")) + 1)).alias("_b"))
    down, aside = F.col("cy") - F.col("ay"), F.col("cx") - F.col("ax")
    met = a.join(numbers.withColumn("_b", at(F.col("cy"))), [*page, "_b"]).where((down > 0) & (down <= reach) & (F.abs(aside) <= reach))
    return met.groupBy(*page, "label", "ax", "ay").agg(F.min(F.struct((down * down + aside * aside).alias("d"), "value")).alias("m")).select(*page, "label", "ax", "ay", "m.value")


def within_window(values: DataFrame, anchors: DataFrame, page: list[str], window: int) -> DataFrame:
    """Occurrences of values within ``window`` characters of an anchor; places in buckets of that width bound the join."""
    # a bucket's anchors are one list, no longer than places and names allow, so that a value meets them in one row
    a = anchors.select(*page, "anchor", F.col("pos").alias("_p"), F.explode(F.sequence(F.floor(F.col("pos") / window) - 1, F.floor(F.col("pos") / window) + 1)).alias("_b"))
    a = a.groupBy(*page, "_b").agg(F.collect_set(F.struct("anchor", "_p")).alias("_a"))
    v = values.where("pos IS NOT NULL").select(*page, "value", "pos").distinct().withColumn("_b", F.floor(F.col("pos") / window))
    near = F.array_distinct(F.transform(F.filter("_a", lambda x: F.abs(F.col("pos") - x["_p"]) <= window), lambda x: x["anchor"]))
    return v.join(a, [*page, "_b"]).select(*page, "value", F.explode(near).alias("anchor")).groupBy(*page, "anchor").agg(F.count("value").alias("hits"))


def articles(texts: DataFrame, marker: str) -> DataFrame:
    """(id, text) to (id, number, title, body): a text cut where a line starts with the marker and a number; the rest of that line is the title.

    What comes before the first marker is no article."""
    parts = texts.select("id", F.posexplode(F.split("text", rf"(?m)^(?={marker}\d)")).alias("pos", "part")).where(F.col("part").rlike(rf"^{marker}\d"))
    head = F.substring_index("part", "\n", 1)
    number = F.regexp_extract(head, rf"^{marker}(\d+(?:-\d+)*)", 1)
    title = F.trim(F.regexp_replace(head, rf"^{marker}\d+(?:-\d+)*", ""))
    return parts.select("id", number.alias("number"), title.alias("title"), F.regexp_replace(F.substring("part", F.char_length(head) + 2, F.char_length("part")), r"^\s+|\s+$", "").alias("body"))


def markers(text: Column) -> Column:
    """The markers [TABLE: ref] and [IMAGE: ref] of a text, in order, as kind and reference."""
    found = F.regexp_extract_all(text, F.lit(r"\[(?:TABLE|IMAGE): [^\]]*\]"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^\[(\w+): ", 1).alias("kind"), F.regexp_extract(m, r": ([^\]]*)\]$", 1).alias("ref"), m.alias("marker")))


def before_markers(texts: DataFrame) -> DataFrame:
    """(id, text) to one row a marker: its place, kind, reference, and the paragraph between the marker before and it."""
    cut = F.split("text", r"\[(?:TABLE|IMAGE): [^\]]*\]")
    rows = texts.select("id", cut.alias("_c"), F.posexplode(markers(F.col("text"))).alias("place", "m"))
    return rows.select("id", "place", "m.kind", "m.ref", F.trim(F.element_at(F.split(F.trim(F.get("_c", F.col("place"))), r"\n\s*\n"), -1)).alias("paragraph"))


def without_last_markers(text: Column) -> Column:
    """The text without the markers that end it."""
    return F.regexp_replace(text, r"(?:\s*\[(?:TABLE|IMAGE|LEGEND|INDEX): [^\]]*\])+\s*$", "")
