"""Text functions, Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE = r"[\x{E000}-\x{F8FF}]"
#: Letters with marks and what they are without, for accent-insensitive keys.
MARKED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def strip_tags(html: Column) -> Column:
    """Tags and no-break spaces become spaces, white space collapses. Contents of scripts and styles stay."""
    plain = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), " |&nbsp;", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text, null for null."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def label_key(text: Column) -> Column:
    """Lower case, Latin accents off, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\s+", " "))


def alphanumeric_key(text: Column) -> Column:
    return F.regexp_replace(label_key(text), "[^a-z0-9]", "")


def expand_first(text: Column, terms: list[tuple[str, str]]) -> Column:
    """After the first whole-word occurrence of each term, any case, its meaning in brackets; later terms see earlier ones."""
    for term, meaning in terms:
        text = F.regexp_replace(text, rf"(?is)^(.*?)\b({re.escape(term)})\b", f"$1$2 ({meaning})")
    return text


def citations(text: Column) -> Column:
    """Numbers cited as [Article n."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[Article (\d+)"), F.lit(1)), lambda x: x.cast("int"))


def is_refusal(text: Column, phrase: str) -> Column:
    """Starts with the agreed phrase and cites nothing."""
    return text.startswith(phrase) & ~text.contains("[Article ")


def broken_words(text: Column, common: list[str]) -> Column:
    """A word of three letters or more, a space, and one to three letters that aren't a common word."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?=\b(\p{L}{3,} \p{Ll}{1,3})\b)"), F.lit(1))
    return F.filter(pairs, lambda x: ~F.element_at(F.split(x, " "), 2).isin(*common))


def title_level(title: Column) -> Column:
    """Level of a numbered title such as B.1.2: one more than its dots, 6 at most; null without a number."""
    code = F.regexp_extract(title, r"^([A-Z](?:\.\d+)*)[\s.:]", 1)
    return F.when(code != "", F.least(F.lit(6), F.length(code) - F.length(F.replace(code, F.lit("."), F.lit(""))) + 1))


def private_removed(text: Column) -> Column:
    """Without private-use characters and the space after them."""
    return F.regexp_replace(text, f"{PRIVATE}[ ]?", "")


def last_segments(path: Column, count: int = 2) -> Column:
    """The last segments of a path array, joined; what an encoder gets in front of a text."""
    return F.concat_ws(" > ", F.slice(path, F.greatest(F.lit(1), F.size(path) - count + 1), count))


def has_jargon(text: Column) -> Column:
    """Identifiers, row or column codes, NULL or file names in a text meant for readers."""
    return text.rlike(r"\b[a-z]+_[a-z_]+\b|\bNULL\b|\b[RC]\d{4}\b|\.\w{2,4}\b")


def csv_text(text: Column) -> Column:
    """A text field of a semicolon file: line ends become bars, formulas are defused, quotes doubled as needed."""
    flat = F.regexp_replace(text, r"\s*\r?\n\s*", " | ")
    safe = F.when(flat.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), flat)).otherwise(flat)
    return F.when(safe.rlike('[;"]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def verdict(reply: Column, yes: str, no: str) -> tuple[Column, Column]:
    """A judge's reply: True unless it starts with ``no``; what follows the colon then is the reworded question."""
    plain = F.trim(reply)
    refused = F.upper(plain).startswith(no.upper())
    reworded = F.trim(F.regexp_extract(plain, r"(?s)^[^:]*:(.*)$", 1))
    return ~F.coalesce(refused, F.lit(False)), F.when(refused & (reworded != ""), reworded)


def name_tokens(name: Column, stop: list[str]) -> Column:
    """Words of a name in lower case: without apostrophes, hyphens as spaces, no stop words."""
    plain = F.regexp_replace(F.regexp_replace(label_key(name), "['\u2019]", ""), "-", " ")
    return F.filter(F.split(plain, r"\s+"), lambda x: (x != "") & ~x.isin(*stop))


def holds_tokens(words: Column, sought: Column) -> Column:
    """Are the sought words in the others, side by side and in order?"""
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(sought) > 0) & padded(words).contains(padded(sought))


def section_code(path: Column) -> tuple[Column, Column]:
    """Code of the deepest segment of a path that has one, such as D.2.1, and its letter."""
    pattern = r"^([A-Z](?:\.\d+)*)(?:[\s.:]|$)"
    deepest = F.filter(F.reverse(path), lambda x: x.rlike(pattern))
    code = F.when(F.size(deepest) > 0, F.regexp_extract(F.get(deepest, F.lit(0)), pattern, 1))
    return code, F.substring(code, 1, 1)


def slug(name: Column) -> Column:
    """Lower-case letters and digits with hyphens for all else."""
    return F.regexp_replace(F.regexp_replace(label_key(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\s*", ""), r"\s*```$", ""))


def holds_label(cell: Column, label: Column) -> Column:
    """Does the cell hold the label, whatever the case?"""
    return F.lower(cell).contains(F.lower(label))


def clean_label(label: Column) -> Column:
    """A component's label for readers: no row code in front, no repeated word at the end, white space collapsed."""
    text = F.regexp_replace(label, r"^\s*[RC]\d{4}\s*[-:]?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\b(\w+) \1$", "$1"))


def strictly_rising(values: Column) -> Column:
    """Is each number of an array greater than the one before it?"""
    later = F.zip_with(values, F.slice(values, F.lit(2), F.size(values)), lambda a, b: F.coalesce(b > a, F.lit(True)))
    return F.forall(later, lambda x: x)
