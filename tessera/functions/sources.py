"""Texts that say where a figure comes from, rewritten for readers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed: a template's number, and its explained mention.
TEMPLATE = r"\bS\.\d{2}\.\d{2}(?:\.\d{2})*\b"
#: Fixed: what no reader should see.
JARGON = [r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b", r"\bNULL\b", r"\b[RrCc]\d{4}\b", r"\b[\w-]+\.(?:py|pdf|json|png|db|md)\b", r"(?i)\b(?:pixel|parser|regex|mapping)"]


def _compatible():
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(normal, StringType())  # made within, so that it goes to workers by value


def compatible(text: Column) -> Column:
    """Compatibility form (NFKC) with every kind of space as a plain one. Texts of ASCII alone aren't sent to Python's tables."""
    plain = F.regexp_replace(text, r"[\x{A0}\x{2009}\x{202F}]", " ")
    return F.when(plain.rlike(r"^\p{ASCII}*$"), plain).otherwise(_compatible()(plain))


def technical(text: Column, explained: str) -> Column:
    """Does a text for readers still hold internal names, codes, file names, a lone chapter, or templates that aren't explained?"""
    lone = text.rlike(r"^\s*[A-E]\.\d\s*$")
    return F.coalesce(F.greatest(lone, *[text.rlike(p) for p in JARGON]) | (F.regexp_count(text, F.lit(TEMPLATE)) > F.regexp_count(text, F.lit(explained))), F.lit(False))


def simple_source(trace: Column, fixed: list[tuple[str, str]], tables: dict[str, str], chapters: dict[str, str], notes: list[tuple[str, str]], explained: str = r"Official table S\.\d{2}\.\d{2}\b") -> Column:
    """A struct (text, fault) of a technical trace (a column of its own, for it is looked at many times): where the figure
    stands, then what a reader should know.

    fixed: (start, text): a trace that starts so is said in these words. Else the place is the chapter in front, or the
    first template by its name, and the texts of all notes (pattern, text) that hit follow, each once; $1 in a note is
    the pattern's first group. A trace whose place isn't known, or whose text is still technical, has a fault and no text."""
    chapter, code = F.regexp_extract(trace, r"^([A-E]\.\d)(?: —|$)", 1), F.regexp_extract(trace, r"\bS\.(\d{2}\.\d{2})(?:\.(\d{2}))?", 1)
    group = F.when(F.regexp_extract(trace, r"\bS\.(\d{2}\.\d{2})(?:\.(\d{2}))?", 2) == "22", " of the group").otherwise("")
    named = lambda names, key: F.create_map(*[F.lit(x) for p in names.items() for x in p])[key]
    place = F.coalesce(F.when(chapter != "", F.concat(F.lit("Report, chapter "), chapter, F.lit(" ("), named(chapters, chapter), F.lit(")"))), F.concat(F.lit("Official table S."), code, F.lit(" ("), named(tables, code), group, F.lit(")")))
    said = F.array(*[F.when(trace.rlike(p), F.regexp_replace(F.regexp_extract(trace, p, 0), f"^(?s).*?{p}.*$", t) if "$1" in t else F.lit(t)) for p, t in notes])
    rest = F.concat_ws("; ", F.array_distinct(F.array_compact(said)))
    text = F.concat(place, F.when(rest != "", F.concat(F.lit(" — "), rest)).otherwise(""))
    for start, words in reversed(fixed):
        text = F.when(trace.startswith(start), words).otherwise(text)
    fault = lambda x: F.when(x.isNull(), "unknown place").when(technical(x, explained), "still technical")
    told = F.transform(F.array(text), lambda x: F.struct(x.alias("text"), fault(x).alias("fault")))[0]  # the text is made once
    return F.when(trace.isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))).otherwise(F.transform(F.array(told), lambda t: F.struct(F.when(t["fault"].isNull(), t["text"]).alias("text"), t["fault"].alias("fault")))[0])


def prefixed_label(label: Column, prefix: str) -> Column:
    """The label without remarks in square brackets, with the prefix in front unless its first six letters are in it."""
    plain = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s*\[.*?\]", ""))
    return F.when(F.lower(plain).contains(prefix.lower()[:6]), plain).otherwise(F.concat(F.lit(f"{prefix}: "), plain))
