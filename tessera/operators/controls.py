"""Controls of a stored ratio against the printed sections it comes from, ranges by activity, and failures known to be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import written

#: One unit of the last printed decimal, for 0 to 3 decimals.
_LAST = [1.0, 0.1, 0.01, 0.001]


def _last(decimals: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in _LAST]), F.least(decimals, F.lit(len(_LAST) - 1)))


def _bucket(x: Column) -> Column:
    """The bucket of a figure of 0 or more: 16 wide below 2^21, then twice as wide with each power of two, so always several times what may differ there.

    Buckets rise with the figure and end at the powers of two."""
    n = F.length(F.bin(F.floor(x / 2.0**20)))
    return F.floor(x / (8 * F.pow(F.lit(2.0), n))) + n * (1 << 18)


def _between(low: Column, high: Column, bucket) -> Column:
    """The bucket of either end, once: an interval narrower than the buckets touches no other."""
    return F.explode(F.array_distinct(F.array(bucket(low), bucket(high))))


def printed_lines(lines: DataFrame, amounts: DataFrame, at: list[str], scales: list[float], sections: DataFrame | None = None) -> DataFrame:
    """(at, idx, value, scale, printed): each line under its section's scale, and the amount that prints it, if any; and the columns of ``sections`` (one row an ``at``).

    An amount prints a line if they differ by half of its last decimal, or a millionth of the line, at most. The scale is
    the one, above zero, under which most lines that aren't zero are printed, the first of equals. Lines meet near amounts
    only: a line is in one bucket, an amount in that of the least and of the greatest line that it may print, mostly the same."""
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(float(s)).alias("scale")) for i, s in enumerate(scales)])).alias("s")
    wanted = lines.where("value <> 0").select(*at, "idx", F.abs("value").alias("_v"), tried).select(*at, "idx", F.col("s.ord").alias("ord"), (F.col("_v") * F.col("s.scale")).alias("_t"))
    wanted = wanted.withColumn("_b", _bucket(F.col("_t")))
    # 1e-6 of a line of up to the amount and a half more is less than this
    far = 0.501 + 1.01e-6 * F.abs("amount")
    there = amounts.where(F.col("amount") + far >= 0).select(*at, "amount", "decimals", _between(F.greatest(F.col("amount") - far, F.lit(0.0)), F.col("amount") + far, _bucket).alias("_b"))
    near = F.abs(F.col("amount") - F.col("_t")) <= 0.5 * _last(F.col("decimals")) + 1e-6 * F.greatest("_t", F.lit(1.0))
    hits = written(wanted.join(there, [*at, "_b"]).where(near).groupBy(*at, "idx", "ord").agg(F.min("amount").alias("printed")))
    best = hits.groupBy(*at, "ord").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max(F.struct("n", (-F.col("ord")).alias("o")))["o"].alias("_o"))
    chosen = lines.join(best, at, "left").withColumn("ord", F.coalesce(-F.col("_o"), F.lit(0))).drop("_o")
    also = [x for x in sections.columns if x not in at] if sections is not None else []
    if also:
        chosen = chosen.join(sections, at, "left")
    scale = F.get(F.array(*[F.lit(float(s)) for s in scales]), F.col("ord"))
    return chosen.join(hits, [*at, "idx", "ord"], "left").select(*at, "idx", "value", scale.alias("scale"), "printed", *also)


def gross_share_net(printed: DataFrame, amounts: DataFrame, at: list[str]) -> DataFrame:
    """(at, gross, scale, share, net): a section's printed reinsurers' share and net figure that add up to its gross lines, or nulls.

    Both are amounts above zero that print none of the lines. net may be negative. They may miss the gross total by half
    of a last decimal for each line and for themselves. Of several pairs the one of least share, then least net."""
    sums = printed.groupBy(*at).agg((F.sum(F.col("value").cast("decimal(38,6)")).cast("double") * F.first("scale")).alias("gross"), F.first("scale").alias("scale"), (0.5 * (F.count("*") + 2)).alias("_tol"))
    lines = printed.where("printed IS NOT NULL").select(*at, F.col("printed").alias("amount")).distinct()
    free = amounts.where("amount > 0").select(*at, "amount", "decimals").distinct().join(lines, [*at, "amount"], "left_anti").join(sums, at)
    wide = lambda x: F.floor(x / (4.5 * F.col("_tol")))  # noqa: E731  more than twice what may differ
    shares = free.select(*at, F.col("amount").alias("share"), F.col("decimals").alias("_d"), (F.col("gross") - F.col("amount")).alias("_rest"), "_tol")
    rest, far = F.abs("_rest"), F.col("_tol") * 1.001
    shares = shares.withColumn("_b", _between(rest - far, rest + far, wide))
    nets = free.select(*at, F.col("amount").alias("net"), F.col("decimals").alias("_e"), wide(F.col("amount")).alias("_b"))
    fit = F.abs(F.abs("_rest") - F.col("net")) <= F.col("_tol") * _last(F.least("_d", "_e"))
    pairs = shares.join(nets, [*at, "_b"]).where(fit)
    found = pairs.groupBy(*at).agg(F.min(F.struct("share", "net", F.when(F.col("_rest") < 0, -F.col("net")).otherwise(F.col("net")).alias("signed"))).alias("p"))
    return sums.join(found, at, "left").select(*at, "gross", "scale", F.col("p.share").alias("share"), F.col("p.signed").alias("net"))


def section_controls(lines: DataFrame, amounts: DataFrame, key: list[str], scales: list[float]) -> DataFrame:
    """(key, check_name, expected, computed, passed, controllable, reason) of the sections' lines and identities.

    lines: key, section, idx, value (in millions). amounts: key, section, amount, decimals, as printed. A line passes if
    it is printed, or zero, and its section's gross, share and net add up. A section without a single amount (a page
    that is a picture) can't be controlled: its lines fail, say so, and have no identity. Null values and amounts are
    left out, repeated amounts count once, empty tables give no rows. ``lines`` are read several times: hand over a table.
    Amounts, what prints a line and sums are written once, compressed."""
    at = [*key, "section"]
    lines = lines.where("value IS NOT NULL").select(*at, "idx", F.col("value").cast("double").alias("value"))
    amounts = written(amounts.where("amount IS NOT NULL").select(*at, F.col("amount").cast("double").alias("amount"), "decimals").distinct())
    sections = amounts.select(*at).distinct().withColumn("_seen", F.lit(True))
    printed = printed_lines(lines, amounts, at, scales, sections)
    printed = written(printed.withColumn("controllable", F.col("_seen").isNotNull()).drop("_seen"))
    sums = written(gross_share_net(printed.where("controllable"), amounts, at))
    adds = F.coalesce(F.col("share").isNotNull(), F.lit(False))
    j = printed.join(sums.select(*at, "share"), at, "left")
    there = (F.col("value") == 0) | F.col("printed").isNotNull()
    reason = F.when(~F.col("controllable"), "no amount in the section").when(F.col("value") == 0, "zero").when(F.col("printed").isNull(), "not printed").otherwise("printed")
    passed = F.col("controllable") & there & adds
    single = j.select(*key, F.concat_ws("_", F.lit("line"), "section", F.col("idx").cast("string")).alias("check_name"), F.col("value").alias("expected"), F.when(passed, F.col("value")).alias("computed"), passed.alias("passed"), "controllable", reason.alias("reason"))
    whole = sums.select(*key, F.concat_ws("_", F.lit("identity"), "section").alias("check_name"), (F.col("gross") / F.col("scale")).alias("expected"), ((F.col("gross") - F.col("share")) / F.col("scale")).alias("computed"), adds.alias("passed"), F.lit(True).alias("controllable"), F.when(adds, "adds up").otherwise("no share and net add up").alias("reason"))
    return single.union(whole)


def ratio_control(lines: DataFrame, stored: DataFrame, key: list[str], above: str, below: str, tolerance: float) -> DataFrame:
    """The same columns for the stored ratio (key, ratio, in percent): section ``above`` over section ``below``, within ``tolerance``."""
    part = lambda s: F.sum(F.when(F.col("section") == s, F.col("value").cast("decimal(38,6)"))).cast("double")
    sums = lines.groupBy(*key).agg(part(above).alias("_a"), part(below).alias("_b"))
    value = F.try_divide("_a", "_b") * 100
    j = stored.where("ratio IS NOT NULL").join(sums, key).withColumn("_v", value).where("_v IS NOT NULL")
    passed = F.abs(F.col("_v") - F.col("ratio")) <= tolerance + 1e-9
    return j.select(*key, F.lit("recomputed_ratio").alias("check_name"), F.col("ratio").alias("expected"), F.col("_v").alias("computed"), passed.alias("passed"), F.lit(True).alias("controllable"), F.when(passed, "agrees").otherwise("differs").alias("reason"))


def in_range_by(figures: DataFrame, ranges: dict[str, tuple[float, float]], kind: str, value: str) -> DataFrame:
    """``figures`` with low, high and passed: the range of the row's kind; kinds without a range and null values are left out."""
    table = F.create_map(*[F.lit(x) for k, (a, b) in ranges.items() for x in (k, F.array(F.lit(a), F.lit(b)))]) if ranges else None
    if table is None:
        return figures.select("*", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(True).alias("passed")).where("false")
    j = figures.where(F.col(value).isNotNull()).withColumn("_r", F.try_element_at(table, F.col(kind))).where("_r IS NOT NULL")
    return j.withColumns({"low": F.col("_r")[0], "high": F.col("_r")[1]}).drop("_r").withColumn("passed", F.col(value).between(F.col("low"), F.col("high")))


def annotated(found: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Controls with state: passed, explained (a failure that ``known`` explains, one row an ``on``) or failed; and its explanation.

    An explained failure stays failed in ``passed``; an explanation of a control that passes is not shown."""
    j = found.join(known.select(*on, F.col("explanation").alias("_e")), on, "left")
    state = F.when(F.col("passed"), "passed").when(F.col("_e").isNotNull(), "explained").otherwise("failed")
    return j.withColumn("state", state).withColumn("explanation", F.when(~F.col("passed"), F.col("_e"))).drop("_e")
