"""Nested snapshots compared path by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(shape: Column) -> Column:
    """Kind of a node by its schema."""
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("value")


def _differ(e: Column) -> Column:
    """False for two values that are the same; whether objects and arrays differ is seen below them."""
    both = lambda kind: (e["_sa"] == kind) & (e["_sb"] == kind)
    inner = F.coalesce((_kind(e["_sa"]) == _kind(e["_sb"])) & (_kind(e["_sa"]) != "value"), F.lit(False))
    text = lambda v: F.try_variant_get(v, "$", "string")
    return F.when(e["_b"].isNull() | inner, True).when(both("STRING"), text(e["_a"]) != text(e["_b"])).otherwise(~F.to_json(e["_a"]).eqNullSafe(F.to_json(e["_b"])))


def _pair(path: Column, x: Column, y: Column) -> Column:
    return F.struct(path.alias("path"), x.alias("_a"), y.alias("_b"), F.schema_of_variant(x).alias("_sa"), F.schema_of_variant(y).alias("_sb"), F.lit(None).cast("string").alias("change"))


def _members() -> Column:
    """Pairs of the members of two objects: those of _a, with null for one that _b lacks."""
    of = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    both = F.map_entries(F.map_zip_with(of("_a"), of("_b"), lambda k, x, y: F.struct(x.alias("x"), y.alias("y"))))
    own = F.filter(both, lambda e: e["value"]["x"].isNotNull())
    return F.transform(own, lambda e: _pair(F.concat("path", F.lit("/"), e["key"]), e["value"]["x"], e["value"]["y"]))


def _elements() -> Column:
    """Pairs of the elements that two arrays both have."""
    of = lambda v: F.try_variant_get(v, "$", "array<variant>")
    both = F.zip_with(of("_a"), of("_b"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    each = F.transform(both, lambda e, i: _pair(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), e["x"], e["y"]))
    return F.filter(each, lambda e: e["_a"].isNotNull() & e["_b"].isNotNull())


def kept_additions(before: DataFrame, after: DataFrame, key: str, ignore: list[str] = (), depth: int = 8) -> DataFrame:
    """(key, path, change) of all that ``after`` doesn't keep as it was ``before``; what it only adds isn't told.

    A member that is missing is *removed*, once, without what is below it; a value or kind that differs is *changed*; an
    array of another length is *resized*, and the elements that both have are compared. Paths that a pattern in ``ignore``
    matches whole, and all below them, are skipped; patterns are Java's. Members are /name, elements [0].

    Both trees of a key (each has one) meet in one row, are parsed once and walked together: a level is one explode of the
    pairs that aren't the same, and a change found goes along as a row. Objects or arrays that both have below ``depth`` are an error."""

    def told(e: Column) -> Column:
        skip = F.lit(False)
        for pattern in ignore:
            skip = skip | e["path"].rlike(rf"^(?:{pattern})(?:[/\[].*)?$")
        return ~skip & _differ(e)

    parsed = lambda df, name: df.select(key, F.parse_json("json").alias(name))
    pairs = parsed(before, "_a").join(parsed(after, "_b"), key)
    root = F.filter(F.array(_pair(F.lit(""), F.col("_a"), F.col("_b")).alias("e")), lambda e: told(e))
    level = pairs.select(key, F.explode(root).alias("e")).select(key, "e.*", F.lit(True).alias("_root"))
    none, no = F.lit(None).cast("variant"), F.lit(None).cast("string")
    for at in range(depth + 1):
        ka, kb, sizes = _kind(F.col("_sa")), _kind(F.col("_sb")), [F.size(F.try_variant_get(v, "$", "array<variant>")) for v in ("_a", "_b")]
        open_, gone = F.col("change").isNull(), F.col("_b").isNull() & ~F.col("_root")
        inner = open_ & ~gone & (ka == kb) & (ka != "value")
        change = F.when(~open_, F.col("change")).when(gone, "removed").when((ka != kb) | (ka == "value"), "changed").when((ka == "array") & (sizes[0] != sizes[1]), "resized")
        own = F.array(F.struct("path", none.alias("_a"), none.alias("_b"), no.alias("_sa"), no.alias("_sb"), change.alias("change")))
        own = F.filter(own, lambda e: e["change"].isNotNull())
        if at == depth:
            deeper = F.when(inner, F.raise_error(F.lit(f"a tree is deeper than {depth}")).cast("string"))
            found = level.select(key, F.explode(own).alias("e"), deeper.alias("_deeper")).where("_deeper IS NULL")
            return found.select(key, "e.path", "e.change")
        below = F.filter(F.when(inner & (ka == "object"), _members()).when(inner, _elements()).otherwise(F.array().cast("array<struct<path:string,_a:variant,_b:variant,_sa:string,_sb:string,change:string>>")), lambda e: told(e))
        level = level.select(key, F.explode(F.concat(own, below)).alias("e")).select(key, "e.*", F.lit(False).alias("_root"))
