"""Operators along an order: as-of joins, fills, spans, islands, ranks and greedy groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, by: list[str], order: str, value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """Adds the last non-null ``value`` at an earlier (or the same) place."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def direct_span(headers: DataFrame, by: list[str], order: str, end: str) -> DataFrame:
    """Adds the place where the next header begins; ``end``'s value after the last."""
    return headers.withColumn("span_end", F.coalesce(F.lead(order).over(Window.partitionBy(*by).orderBy(order)), F.col(end)))


def subtree_span(headers: DataFrame, by: list[str], order: str, level: str, end: str, levels: int = 6) -> DataFrame:
    """Adds the place of the next header of the same or a higher level; headers deeper than ``levels`` count as of that level.

    For each level the next header at or above it is a running minimum in descending order, so that each row adds to it once."""
    own = F.least(F.col(level), F.lit(levels))
    later = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.min(F.when(own <= x, F.col(order))).over(later) for x in range(1, levels + 1)]
    return headers.withColumn("_n", F.array(*nexts)).withColumn("subtree_end", F.coalesce(F.element_at("_n", own), F.col(end))).drop("_n")


def heading_path(headers: DataFrame, by: list[str], order: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """Adds the path of open headers above and including each: the last title of a level, unless a higher header came since."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {x: F.max(F.when(F.col(level) == x, F.struct(F.col(order).alias("at"), F.col(title).alias("title")))).over(upto) for x in range(1, levels + 1)}
    df = headers.withColumns({f"_l{x}": last[x] for x in last})
    above = {x: F.greatest(*[F.coalesce(F.col(f"_l{y}.at"), F.lit(-1)) for y in range(1, x)], F.lit(-1)) if x > 1 else F.lit(-1) for x in last}
    parts = [F.when((F.col(level) >= x) & (F.col(f"_l{x}.at") > above[x]), F.col(f"_l{x}.title")) for x in last]
    return df.withColumn("path", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop(*[f"_l{x}" for x in last])


def islands(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds island, equal for rows whose ``order`` goes up by one."""
    return df.withColumn("island", F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def best_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group; Spark keeps one a partition before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def greedy_groups(df: DataFrame, by: list[str], order: str, size: str, least: int, most: int) -> DataFrame:
    """Collects ordered units into groups: one closes when it has ``least`` and the next would take it past ``most``.

    Returns the keys, group, first and last unit, total. The fold runs over one array a key (a document's units) and
    touches closed groups only when another one closes."""
    units = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n")))).alias("u"))
    group = "struct<first:bigint,last:bigint,total:bigint>"
    start = F.struct(F.expr(f"cast(array() as array<{group}>)").alias("closed"), F.lit(None).cast(group).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        now, closed = acc["open"], acc["closed"]
        new = F.struct(x["o"].alias("first"), x["o"].alias("last"), x["n"].alias("total"))
        grown = F.struct(now["first"].alias("first"), x["o"].alias("last"), (now["total"] + x["n"]).alias("total"))
        full = (now["total"] >= least) & (now["total"] + x["n"] > most)
        of = lambda c, o: F.struct(c.alias("closed"), o.alias("open"))
        return F.when(now.isNull(), of(closed, new)).when(full, of(F.concat(closed, F.array(now)), new)).otherwise(of(closed, grown))

    groups = F.aggregate("u", start, step, lambda acc: F.concat(acc["closed"], F.array(acc["open"])))
    return units.select(*by, F.posexplode(groups).alias("group", "g")).select(*by, "group", "g.first", "g.last", "g.total")


def global_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place, from 1 on, by ``order`` over all rows; no task sees more than a range of them.

    Rows are dealt by ranges and written to the session's checkpoint folder, for ranges come from samples; places are
    counted in a range, and the ranges' sizes before it (a row a range) are broadcast."""
    from tessera.sources.files import checkpoints

    checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")
