"""The table of long-term measures: built from three kinds of reports, whole, and equal to the stored indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.warehouse import require

#: How many of a unit make a million.
DIVISORS = {"thousands": 1_000.0, "units": 1_000_000.0, "millions": 1.0}
KEY = ["company_id", "year"]


def measure_table(tables: DataFrame, published: DataFrame, unused: DataFrame) -> DataFrame:
    """One row a company and year, figures in millions, from three sources; a company in two of them keeps the first.

    tables: unit, fp_with, scr_with and the steps d_fp_va, d_scr_va, d_fp_tr, d_scr_tr of a printed table. published: the
    ratio without the adjustment, where that is all that is published. unused: companies that use none. Null steps count
    as 0; a transitional measure is in use where either of its steps isn't 0. An unknown unit gives null figures."""
    k = F.try_element_at(F.create_map(*[F.lit(x) for u in DIVISORS.items() for x in u]), F.col("unit"))
    part = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) / k).alias(c)
    steps = ["d_fp_va", "d_scr_va", "d_fp_tr", "d_scr_tr"]
    used = (F.coalesce("d_fp_tr", F.lit(0.0)) != 0) | (F.coalesce("d_scr_tr", F.lit(0.0)) != 0)
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    fixed = lambda values: [v.alias(n) for n, v in zip(steps, values)]
    a = tables.select(*KEY, F.lit(0).alias("_s"), F.lit(True).alias("uses_va"), used.alias("transitional"), (F.col("fp_with") / k).alias("fp_with"), (F.col("scr_with") / k).alias("scr_with"), *[part(c) for c in steps], none.alias("published_ratio"))
    b = published.select(*KEY, F.lit(1), F.lit(True), F.lit(False), none, none, *fixed([none, none, zero, zero]), F.col("published_ratio").cast("double"))
    c = unused.select(*KEY, F.lit(2), F.lit(False), F.lit(False), none, none, *fixed([zero, zero, zero, zero]), none)
    rows = a.union(b).union(c)
    rest = [n for n in rows.columns if n not in [*KEY, "_s"]]
    first = rows.groupBy(*KEY).agg(F.min(F.struct("_s", *rest)).alias("m"))
    return first.select(*KEY, *[F.col(f"m.{n}").alias(n) for n in rest])


def without_measure_row(companies: DataFrame, measures: DataFrame) -> DataFrame:
    """The companies that no source tells anything of."""
    return companies.join(measures.select("company_id").distinct(), "company_id", "left_anti")


def unlike_stored(measures: DataFrame, stored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows whose figures with measures aren't the stored own funds and requirement (own_funds, scr_total); rows without either are left out."""
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance
    j = measures.where("fp_with IS NOT NULL").join(stored.select(*KEY, "own_funds", "scr_total"), KEY)
    wrong: Column = F.coalesce(off("fp_with", "own_funds"), F.lit(False)) | F.coalesce(off("scr_with", "scr_total"), F.lit(False))
    return j.where(wrong).select(*KEY, "fp_with", "own_funds", "scr_with", "scr_total")


def whole_measure_table(companies: DataFrame, stored: DataFrame, tables: DataFrame, published: DataFrame, unused: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``measure_table`` if every company has a row and no figure is unlike the stored ones; else an error that names the rule."""
    made = measure_table(tables, published, unused)
    require(made, without_measure_row(companies, made).limit(1), "a company has no row of measures")
    return require(made, unlike_stored(made, stored, tolerance).limit(1), "figures with measures are unlike the stored ones")
