"""Guarded changes of a table: compare-and-set patches in ordered steps, with a journal of what became of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.warehouse import require


@dataclass
class Patched:
    table: DataFrame
    journal: DataFrame


def apply(table: DataFrame, patches: DataFrame, key: list[str], columns: list[str]) -> Patched:
    """Patches (patch_id, step, key, action, guards, sets) applied to the ``columns`` of the row with their key.

    guards: column to the value it must have (null: must be null), as text of the column's type; sets: column to its new
    value. Patches of a row go by step, then patch_id, and each sees what those before it made of the row; all of it is
    one join, however many steps there are. A patch is *applied*; *refused* if a guard doesn't hold; *absent* if no row
    has its key, or an earlier patch deleted it; *ambiguous* if several rows have it, none of which changes. The journal
    has one row a patch: patch_id, step, key, status, rows (that have the key before any patch) and before, the old
    values of the columns it set. A key with a null finds no row. Work on a row grows with its patches squared: they are
    corrections, a few a row."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    unknown = [x for x in columns if x not in kinds or x in key]
    if unknown:
        raise ValueError(f"not columns beside the key: {unknown}")
    entry = "map<string,string>"
    one = F.struct("step", "patch_id", "action", F.coalesce("guards", F.expr(f"cast(map() as {entry})")).alias("guards"), F.coalesce("sets", F.expr(f"cast(map() as {entry})")).alias("sets"))
    order = lambda a, b: F.when((a["step"] < b["step"]) | ((a["step"] == b["step"]) & (a["patch_id"] < b["patch_id"])), -1).otherwise(1)
    per = patches.groupBy(*key).agg(F.array_sort(F.collect_list(one), order).alias("_patches"))
    counts = table.join(per.select(*key), key, "left_semi").groupBy(*key).agg(F.count("*").alias("_rows"))
    per = per.join(counts, key, "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    row = [F.col(x).alias(x) for x in columns]
    log = "array<struct<patch_id:bigint,step:int,status:string,before:map<string,string>>>"
    start = F.struct(*row, F.lit(True).alias("_alive"), F.expr(f"cast(array() as {log})").alias("_log"))

    def then(state: Column, patch: Column) -> Column:
        holds = F.lit(True)
        for x in columns:
            holds = holds & (~F.map_contains_key(patch["guards"], x) | state[x].eqNullSafe(patch["guards"][x].try_cast(kinds[x])))
        known = F.forall(F.map_keys(patch["guards"]), lambda g: g.isin(*columns))
        applied = state["_alive"] & holds & known
        sets = applied & (patch["action"] == "set")
        changed = [F.when(sets & F.map_contains_key(patch["sets"], x), patch["sets"][x].try_cast(kinds[x])).otherwise(state[x]).alias(x) for x in columns]
        status = F.when(~state["_alive"], "absent").when(applied, "applied").otherwise("refused")
        old = F.map_filter(F.create_map(*[y for x in columns for y in (F.lit(x), state[x].cast("string"))]), lambda k, _: F.map_contains_key(patch["sets"], k))
        told = F.struct(patch["patch_id"].cast("long").alias("patch_id"), patch["step"].cast("int").alias("step"), status.alias("status"), F.when(sets, old).alias("before"))
        return F.struct(*changed, (state["_alive"] & ~(applied & (patch["action"] == "delete"))).alias("_alive"), F.concat(state["_log"], F.array(told)).alias("_log"))

    single = per.where("_rows = 1").drop("_rows")
    met = table.join(single, key, "left").withColumn("_state", F.when(F.col("_patches").isNotNull(), F.aggregate("_patches", start, then)))
    kept = met.where("_state IS NULL OR _state._alive")
    after = kept.select(*[F.when(F.col("_state").isNotNull(), F.col(f"_state.{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in table.columns])
    done = met.where("_state IS NOT NULL").select(*key, F.explode("_state._log").alias("l")).select("l.patch_id", "l.step", *key, "l.status", F.lit(1).cast("long").alias("rows"), "l.before")
    status = F.when(F.col("_rows") == 0, "absent").otherwise("ambiguous")
    rest = per.where("_rows <> 1").select(*key, "_rows", F.explode("_patches").alias("p"))
    rest = rest.select(F.col("p.patch_id").cast("long").alias("patch_id"), F.col("p.step").cast("int").alias("step"), *key, status.alias("status"), F.col("_rows").alias("rows"), F.lit(None).cast(entry).alias("before"))
    return Patched(after, done.unionByName(rest))


def applied_all(patched: Patched) -> DataFrame:
    """The table, if each patch changed exactly one row; else an error, and nothing is to be written."""
    return require(patched.table, patched.journal.where("status <> 'applied'").limit(1), "a patch found no row, several, or other values than it expects")


def counters(journal: DataFrame) -> DataFrame:
    """Patches by step and status."""
    return journal.groupBy("step", "status").agg(F.count("*").alias("patches"))


def typed_corrections(rows: DataFrame, typed: DataFrame, parse, divisor, key: list[str], order: str = "year") -> Patched:
    """Figures that people typed (key, text, unit, comment, ts) in place of the value of the key's last ``order``.

    The text is parsed and divided by its unit's divisor; validated becomes true; a row without raw value keeps its old
    value as such. Of several for one key the last by ts counts, though all are in the journal: key, year, old and new
    value, comment, ts and state: written, *replaced* by a later one, *unreadable* text or unit, or *unknown* key."""
    last = rows.groupBy(*key).agg(F.max(order).alias(order))
    new = parse(F.col("text")) / divisor(F.col("unit"))
    read = typed.withColumn("_new", new).join(last, key, "left")
    state = F.when(F.col(order).isNull(), "unknown").when(F.col("_new").isNull(), "unreadable")
    best = read.where(state.isNull()).groupBy(*key, order).agg(F.max(F.struct("ts", "_new", "comment")).alias("_b"))
    written = rows.join(best, [*key, order], "left")
    given = F.col("_b").isNotNull()
    changes = {"raw_value": F.when(given, F.coalesce("raw_value", "value")).otherwise(F.col("raw_value")), "value": F.when(given, F.col("_b._new")).otherwise(F.col("value")), "validated": F.col("validated") | given}
    table = written.select(*[changes[x].alias(x) if x in changes else F.col(x) for x in rows.columns])
    told = read.join(rows.select(*key, order, F.col("value").alias("old_value")), [*key, order], "left").join(best.select(*key, F.col("_b.ts").alias("_ts"), F.col("_b._new").alias("_last")), key, "left")
    final = F.coalesce(state, F.when((F.col("ts") == F.col("_ts")) & (F.col("_new") == F.col("_last")), "written").otherwise("replaced"))
    return Patched(table, told.select(*key, order, "old_value", F.col("_new").alias("new_value"), "comment", "ts", final.alias("state")))
