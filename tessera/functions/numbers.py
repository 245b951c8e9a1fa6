"""Parsing, scaling and formatting of figures as reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s    ]"


def _bare(raw: Column) -> Column:
    text = F.replace(F.regexp_replace(raw, SPACES, ""), F.lit(","), F.lit("."))
    return F.regexp_replace(F.regexp_replace(text, "^[−–](?=.)", "-"), r"^\((.+)\)$", "-$1")


def _value(body: Column) -> Column:
    value = F.regexp_replace(body, "%$", "").try_cast("double")
    return F.when(body.isin("-", "–", "−"), F.lit(0.0)).when(body.endswith("%"), value / 100).otherwise(value)


def parse_number(raw: Column) -> Column:
    """A printed figure: any spaces between digits, comma or point, (x) negative, x% a fraction, a lone dash 0; else null."""
    return _value(_bare(raw))


def parse_numbers(raw: Column) -> Column:
    """The figures of an array, each text being stripped once."""
    return F.transform(F.transform(raw, _bare), _value)


def is_fragment(text: Column) -> Column:
    """Could the text be part of a figure? Sign, digits with spaces, comma or point, percent or brackets."""
    return text.rlike(rf"^\(?[-−–+]?\d[\d.,]*(?:{SPACES}\d+)*%?\)?$|^[-−–]$")


def parse_amount(raw: Column) -> tuple[Column, Column]:
    """Absolute value and printed decimals; a point before three digits groups thousands."""
    text = F.regexp_replace(F.regexp_replace(raw, SPACES, ""), r"[()\-−]", "")
    grouped = text.rlike(r"^\d{1,3}(?:\.\d{3})+(?:,\d+)?$")
    plain = F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    plain = F.replace(plain, F.lit(","), F.lit("."))
    good = plain.rlike(r"^\d+(?:\.\d+)?$")
    decimals = F.when(plain.contains("."), F.length(F.substring_index(plain, ".", -1))).otherwise(0)
    return F.when(good, plain.try_cast("double")), F.when(good, decimals)


def unit_divisor(unit: Column) -> Column:
    """What a figure in a report's unit is divided by to be in millions; null for an unknown unit."""
    u = F.lower(unit)
    return F.when(u.contains("thousand") | u.startswith("k"), 1e3).when(u.contains("million") | u.startswith("m"), 1.0).when(u.startswith("eur"), 1e6)


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def printed(value: Column, digits: int = 1) -> Column:
    """Thousands apart by spaces, decimal comma, a true minus sign."""
    text = F.translate(F.format_number(F.abs(value), digits), ",.", " ,")
    return F.when(value < 0, F.concat(F.lit("−"), text)).otherwise(text)


def csv_number(value: Column) -> Column:
    """At most three decimals with a comma, without trailing zeros; empty for null."""
    fixed = F.format_string("%.3f", F.round(value, 3) + 0.0)
    short = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), "").otherwise(F.replace(short, F.lit("."), F.lit(",")))


def relative_gap(a: Column, b: Column) -> Column:
    """Percent of the larger magnitude, which counts as 1 at least."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 100


def available(value: Column) -> Column:
    """The value if it is a finite number, else null. A real 0 stays."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lower(F.hex(variant)), part(18, 3)), part(21, 12))


def user_number(raw: Column) -> Column:
    """A figure that a user typed: spaces between digits group thousands, one comma is the decimal mark; anything else is null."""
    text = F.regexp_replace(F.trim(raw), r"(?<=\d)[ \u00A0\u202F](?=\d)", "")
    one = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) == 1) & ~text.contains(".")
    text = F.when(one, F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def scanned_integer(raw: Column) -> Column:
    """An integer of three digits or more as a scan gives it, with spaces, points or commas between digits; else null."""
    digits = F.regexp_replace(raw, r"[ .,\u00A0\u202F]", "")
    return F.when(digits.rlike(r"^-?\d{3,18}$"), digits.try_cast("long"))


def printed_forms(value: Column) -> Column:
    """How a report may print a figure: rounded, with spaces or nothing between thousands, and with three decimals and a comma."""
    clean = F.round(value, 6)
    whole = F.format_string("%d", F.round(clean).cast("long"))
    return F.array_distinct(F.array(F.replace(F.format_number(F.round(clean), 0), F.lit(","), F.lit(" ")), whole, F.replace(F.format_string("%.3f", clean), F.lit("."), F.lit(","))))


def spaced(value: Column, digits: int) -> Column:
    """Thousands apart by spaces, decimal comma."""
    return F.translate(F.format_number(value, digits), ",.", " ,")


def with_unit(value: Column, unit: Column, raw: Column, raw_unit: Column) -> Column:
    """A value for display: percent with one decimal; the raw figure where it is known, whole in small units; else by unit."""
    small = raw_unit.isin("K", "EUR")
    shown = F.when(small, F.concat_ws(" ", spaced(raw, 0), raw_unit)).otherwise(F.concat_ws(" ", spaced(raw, 1), raw_unit))
    plain = F.when(unit == "BEUR", spaced(value, 2)).otherwise(spaced(value, 1))
    return F.when(unit == "pct", F.concat(spaced(value, 1), F.lit(" %"))).when(raw.isNotNull(), shown).otherwise(F.concat_ws(" ", plain, unit))


def signed(value: Column, unit: str) -> Column:
    """A variation with its sign, one decimal and the unit."""
    return F.concat(F.when(value >= 0, "+").otherwise(""), F.format_string("%.1f", value), F.lit(f" {unit}"))


def units(value: Column) -> Column:
    """A figure of up to eight decimals as a whole number of hundred-millionths."""
    return F.floor(value * 1e8 + 0.5).cast("decimal(20,0)")


def exact_ratio(a: Column, b: Column, factor: int, digits: int) -> Column:
    """a / b * factor to ``digits`` decimals, halves away from zero, in whole numbers throughout; null where b is 0.

    A quotient of doubles may lie on either side of a half that the figures themselves meet exactly."""
    up = F.call_function("div", F.abs(a) * (2 * factor * 10**digits) + F.abs(b), F.nullif(F.abs(b) * 2, F.lit(0).cast("decimal(38,0)")))
    return F.when((a < 0) != (b < 0), -up).otherwise(up) / F.lit(10.0**digits)
