"""Building indicators: gated components, fallbacks, computed indicators with lineage, and checks against printed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["company_id", "year"]


def gated_components(components: DataFrame, stored: DataFrame, pct: float, least: float) -> DataFrame:
    """Components (key, kpi_name, label, component_value) whose sum agrees with the stored value, and why others don't go in.

    Agreement is within ``pct`` percent of the stored value, ``least`` at least. outcome: inserted, gap or no stored value."""
    key = [*KEY, "kpi_name"]
    sums = components.groupBy(*key).agg(F.sum(F.col("component_value").cast("decimal(38,8)")).cast("double").alias("recomposed"), F.count("*").alias("n"))
    j = sums.join(stored.select(*key, "value"), key, "left")
    close = F.abs(F.col("recomposed") - F.col("value")) <= F.greatest(F.abs("value") * pct / 100, F.lit(least))
    outcome = F.when(F.col("value").isNull(), "no stored value").when(close, "inserted").otherwise("gap")
    return j.select(*key, "n", F.round("recomposed", 6).alias("recomposed"), outcome.alias("outcome"))


def inserted_components(components: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The component rows of keys that passed the gate, numbered from 1 by label."""
    from pyspark.sql import Window

    key = [*KEY, "kpi_name"]
    passed = outcomes.where("outcome = 'inserted'").select(*key)
    return components.join(passed, key).withColumn("component_index", F.row_number().over(Window.partitionBy(*key).orderBy("label")))


def derived_sum(kpis: DataFrame, parts: list[str], name: str) -> DataFrame:
    """(key, kpi_name, value): the sum of the parts, null unless all are there."""
    from tessera.operators.indicators import wide

    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return wide(kpis, parts).select(*KEY, F.lit(name).alias("kpi_name"), total.alias("value"))


def pair_components(kpis: DataFrame, parts: list[str], whole: str, tolerance: float) -> DataFrame:
    """The two parts of a whole as component rows, where they add up to it within the tolerance."""
    from tessera.operators.indicators import wide

    w = wide(kpis, [*parts, whole]).where(F.abs(F.col(parts[0]) + F.col(parts[1]) - F.col(whole)) <= tolerance)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("component_index"), F.lit(p).alias("label"), F.col(p).alias("component_value")) for i, p in enumerate(parts)])
    return w.select(*KEY, F.lit(whole).alias("kpi_name"), F.explode(rows).alias("r")).select(*KEY, "kpi_name", "r.*")


def label_fallback(cells: DataFrame, labels: DataFrame, key: list[str], preferred: list[str]) -> DataFrame:
    """For each key and indicator the cell whose normalised label is the expected one: of the preferred columns, else the sole one."""
    from tessera.functions.text import label_key

    met = cells.withColumn("_l", label_key(F.col("label"))).join(labels.withColumn("_l", label_key(F.col("expected"))).select("kpi_name", "_l"), "_l")
    g = met.groupBy(*key, "kpi_name").agg(*[F.max(F.when(F.col("column") == p, F.col("value"))).alias(f"_p{i}") for i, p in enumerate(preferred)], F.count("*").alias("_n"), F.max("value").alias("_only"))
    return g.select(*key, "kpi_name", F.coalesce(*[F.col(f"_p{i}") for i in range(len(preferred))], F.when(F.col("_n") == 1, F.col("_only"))).alias("value"))


def cross_source(a: DataFrame, b: DataFrame, key: list[str], pct: float) -> DataFrame:
    """Two sources' values of a key, their gap in percent and whether it is small enough; keys of one source only are told."""
    from tessera.functions.numbers import relative_gap

    j = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key, "full")
    gap = F.round(relative_gap(F.col("a"), F.col("b")), 6)
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "one source").when(gap <= pct, "agree").otherwise("differ")
    return j.select(*key, "a", "b", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), gap).alias("gap"), state.alias("state"))


def sign_corrected(components: DataFrame, label: str, most: float) -> DataFrame:
    """Parents summed anew after the sign of the component with the label was turned, if its size is within ``most``."""
    turn = (F.col("label") == label) & (F.abs("component_value") <= most)
    v = F.when(turn, -F.col("component_value")).otherwise(F.col("component_value"))
    return components.groupBy(*KEY, "kpi_name").agg(F.round(F.sum(v.cast("decimal(38,8)")).cast("double"), 6).alias("value"), F.count_if(turn).alias("turned"))


def entity_values(rows: DataFrame, entities: DataFrame, expected: int) -> DataFrame:
    """Values of several entities at once, each divided by its entity's divisor (1000 if not listed; percentages as they are), with coverage."""
    j = rows.join(entities, "company_id", "left")
    value = F.when(F.col("unit") == "pct", F.col("value")).otherwise(F.col("value") / F.coalesce("divisor", F.lit(1000.0)))
    return j.withColumn("value", F.round(value, 8)).groupBy(*KEY).agg(F.count("value").alias("n"), F.round(F.count("value") / expected, 4).alias("coverage"), F.round(F.sum(F.col("value").cast("decimal(38,8)")).cast("double"), 6).alias("total"))


def registry_check(kpis: DataFrame, registry: DataFrame, tolerance: float) -> DataFrame:
    """Stored values against a registry of values read elsewhere (company_id, kpi_name, expected, origin)."""
    j = registry.join(kpis.select(*KEY, "kpi_name", "value"), ["company_id", "kpi_name"])
    return j.select(*KEY, "kpi_name", "expected", "value", "origin", (F.abs(F.col("value") - F.col("expected")) <= tolerance).alias("passed"))


def printed_presence(targets: DataFrame, amounts: DataFrame, key: list[str], scales: list[float]) -> DataFrame:
    """Is each target printed, to the rounding of what is printed? For the one scale that most of a key's targets are found at.

    ``amounts`` has printed (amount, decimals); the first scale wins ties."""
    scaled = targets.select(*key, "name", "target", F.posexplode(F.array(*[F.lit(s) for s in scales])).alias("ordinal", "scale"))
    scaled = scaled.withColumn("goal", F.abs(F.col("target")) * F.col("scale"))
    near = F.abs(F.col("amount") - F.col("goal")) <= F.lit(0.5) * F.pow(F.lit(10.0), -F.col("decimals")) + F.lit(1e-6) * F.greatest("goal", F.lit(1.0))
    found = scaled.join(amounts, key, "left").groupBy(*key, "name", "ordinal", "scale").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("found"))
    best = found.groupBy(*key, "ordinal", "scale").agg(F.count_if("found").alias("hits")).groupBy(*key).agg(F.min(F.struct(-F.col("hits"), "ordinal", "scale")).alias("_b"))
    return found.join(best.select(*key, F.col("_b.scale").alias("scale"), (-F.col("_b.col1")).alias("hits")), [*key, "scale"]).select(*key, "name", "scale", "hits", "found")


def table_identity(amounts: DataFrame, gross: DataFrame, key: list[str]) -> DataFrame:
    """Does a printed share and a printed net satisfy sum of gross - share = +-net, to the rounding of what is printed?

    Neither may be one of the gross lines; a table prints few amounts, so its pairs are few. The first pair by position is told."""
    sums = gross.groupBy(*key).agg(F.sum("value").alias("total"), F.count("*").alias("_n"), F.collect_list(F.abs("value")).alias("_g"))
    able = amounts.where("amount > 0").join(sums, key).where(~F.exists("_g", lambda g: F.abs(g - F.col("amount")) <= 0.5 * F.pow(F.lit(10.0), -F.col("decimals"))))
    share, net = able.alias("p"), able.alias("q")
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in key]
    step = (F.col("p._n") + 2) * 0.5 * F.pow(F.lit(10.0), -F.least("p.decimals", "q.decimals"))
    plus, minus = F.abs(F.col("p.total") - F.col("p.amount") - F.col("q.amount")) <= step, F.abs(F.col("p.total") - F.col("p.amount") + F.col("q.amount")) <= step
    on = same[0]
    for x in same[1:]:
        on = on & x
    hits = share.join(net, on & (plus | minus)).select(*[F.col(f"p.{k}").alias(k) for k in key], F.struct(F.col("p.pos").alias("a"), F.col("q.pos").alias("b"), F.when(plus, 1).otherwise(-1).alias("sign")).alias("h"))
    best = hits.groupBy(*key).agg(F.min("h").alias("h"))
    return sums.select(*key).join(best, key, "left").select(*key, F.col("h").isNotNull().alias("holds"), F.col("h.a").alias("share_pos"), F.col("h.b").alias("net_pos"), F.col("h.sign").alias("sign"))


def component_class(code: Column, label: Column, other: str, one: str, codes: dict[str, str]) -> Column:
    """Class of a component by its row code, else by the words of its label; null if neither tells."""
    text = F.concat_ws(" ", code, label)
    by_code = F.lit(None).cast("string")
    for c, name in codes.items():
        by_code = F.when(text.contains(c), name).otherwise(by_code)
    low = F.lower(text)
    return F.coalesce(by_code, F.when(low.contains(other), other).when(low.contains(one), one))
