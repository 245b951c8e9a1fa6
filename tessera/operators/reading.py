"""Reading indicators: strict and graceful lookups, filters by several keys, and labels for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["company_id", "year", "kpi_name"]


def lookup(requests: DataFrame, kpis: DataFrame) -> DataFrame:
    """Each request (company_id, year, kpi_name) with its row, or nulls: the graceful contract."""
    return requests.join(kpis, KEY, "left")


def strict_lookup(requests: DataFrame, kpis: DataFrame, companies: DataFrame) -> DataFrame:
    """The same, but a company that isn't known fails the job: the strict contract."""
    known = companies.select("company_id", F.lit(True).alias("_known"))
    sure = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown company "), F.col("company_id").cast("string"))).cast("boolean")).otherwise(True)
    return lookup(requests.join(known, "company_id", "left").where(sure).drop("_known"), kpis)


def optional_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that have each wanted value; None takes any."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def search_filter(rows: DataFrame, text: str, group: Column | None = None) -> DataFrame:
    """Rows whose name holds the text, whatever its case and spaces around it, in a group if one is asked for."""
    found = rows.where(F.lower("name").contains(text.strip().lower()))
    return found if group is None else found.where(group)


def applicable(kpi: Column, activity: Column, rules: dict[str, list[str]]) -> Column:
    """Does the indicator make sense for the activity? Those without a rule always do."""
    out = F.lit(True)
    for name, activities in rules.items():
        out = F.when(kpi == name, activity.isin(*activities)).otherwise(out)
    return out


def numbered_pattern(name: Column, prefix: str) -> tuple[Column, Column]:
    """The part between a prefix and a trailing number, and that number."""
    pattern = rf"^{prefix}(.*)_(\d+)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).try_cast("int")


def without_suffix(text: Column, suffix: Column) -> Column:
    """The text without the suffix and the space before it, if it ends with them."""
    end = F.concat(F.lit(" "), suffix)
    return F.when(text.endswith(end), F.substring(text, F.lit(1), F.char_length(text) - F.char_length(end))).otherwise(text)


def confidence(value: Column, validated: Column) -> Column:
    return F.when(value.isNull(), "missing").when(validated, "verified").otherwise("extracted")


def by_prefix(text: Column, families: list[tuple[str, str]], other: str) -> Column:
    """The family of the first prefix that the text starts with."""
    out = F.lit(other)
    for prefix, family in reversed(families):
        out = F.when(text.startswith(prefix), family).otherwise(out)
    return out


def display_codes(catalogue: DataFrame) -> DataFrame:
    """(category, kpi_name, ordinal): a code of the category's first letter and a running number in declared order."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("ordinal"))
    return catalogue.withColumn("code", F.concat(F.upper(F.substring("category", 1, 1)), F.format_string("%02d", place)))


def unique_match(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each left row with the value of its only match; null, and a reason, if there is none or more than one."""
    one = right.groupBy(*key).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    j = left.join(one, key, "left")
    reason = F.when(F.col("_n").isNull(), "absent").when(F.col("_n") > 1, "ambiguous")
    return j.withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).withColumn("reason", reason).drop("_n", "_v")


def canonical(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """References replaced by what they are aliases of."""
    return rows.join(aliases.select("ref", F.col("target").alias("_t")), "ref", "left").withColumn("canonical", F.coalesce("_t", "ref")).drop("_t")


def subsidiaries(companies: DataFrame) -> DataFrame:
    """(parent_id, n, least, greatest): companies that consolidate at least one other, with how many and their first and last."""
    owned = companies.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("company_id").alias("first_child"), F.max("company_id").alias("last_child"))
    return owned.join(companies.select(F.col("company_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id")


def first_seen_texts(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Distinct texts of a key in the order in which they first occur, joined by bars. A key has few texts: formulas of an indicator."""
    first = rows.groupBy(key, text).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", text))), lambda x: x[text]), " | ").alias("texts"))


def issue_groups(issues: DataFrame, key: str, file: str, examples: int = 3) -> DataFrame:
    """(key, files, examples): how many files have an issue, most first, with the first of them."""
    per = issues.select(key, file).distinct()
    first = per.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(file))).where(F.col("_r") <= examples)
    some = first.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.col(file).cast("string"))), ",").alias("examples"))
    return per.groupBy(key).agg(F.count("*").alias("files")).join(some, key)


def with_independents(companies: DataFrame, group: str, label: str) -> DataFrame:
    """Members of each group, and of a pseudo-group of those without one, most first, then by name."""
    counts = companies.groupBy(F.coalesce(group, F.lit(label)).alias("group_name")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "group_name")))


def nulls_by_direction(value: Column, ascending: bool) -> Column:
    """Nulls first going up, last going down."""
    return value.asc_nulls_first() if ascending else value.desc_nulls_last()


def worst_first(alerts: DataFrame) -> DataFrame:
    """(company_id, rule, level): each company's worst alert (ties by rule), and how many it has of each level."""
    return alerts.groupBy("company_id").agg(F.min(F.struct("level", "rule")).alias("_w"), F.count("*").alias("n"), F.count_if(F.col("level") == 1).alias("dangers")).select("company_id", "_w.level", "_w.rule", "n", "dangers")


def mergeable(cells: DataFrame, sheet: list[str], code: str) -> DataFrame:
    """(sheet, signature, partners): sheets whose sets of row codes are equal to another's and may be joined side by side.

    A sheet has few row codes; equal sets get equal signatures."""
    sets = cells.groupBy(*sheet).agg(F.array_join(F.sort_array(F.collect_set(F.col(code).cast("string"))), ",").alias("signature"))
    many = sets.groupBy("signature").agg((F.count("*") - 1).alias("partners")).where("partners > 0")
    return sets.join(many, "signature")


def template_lists(mapping: DataFrame, key: str) -> DataFrame:
    """(key, priority, template, rows array) to templates, each once by its first priority, and all row codes, sorted. A key has few variants."""
    first = mapping.groupBy(key, "template").agg(F.min("priority").alias("_p"))
    listed = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "template"))), lambda x: x["template"]).alias("templates"))
    codes = mapping.select(key, F.explode("rows").alias("_c")).groupBy(key).agg(F.sort_array(F.collect_set("_c")).alias("row_codes"))
    return listed.join(codes, key, "left")


def batch_scores(values: DataFrame, file: str) -> DataFrame:
    """(file, value, how) to one row a file: values found by code, by label, and not at all, and the percentage found."""
    found = F.col("value").isNotNull()
    g = values.groupBy(file).agg(F.count_if(found & (F.col("how") == "code")).alias("by_code"), F.count_if(found & (F.col("how") == "label")).alias("by_label"), F.count_if(~found).alias("missing"), F.count("*").alias("n"))
    return g.withColumn("score", F.floor((F.col("by_code") + F.col("by_label")) * 1000 / F.col("n")) / 10)
