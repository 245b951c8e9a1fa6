"""A Merkle manifest of a table: digests built bottom-up and written level by level, proofs pushed top-down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, at most.
ARITY = 16
PROOF = "array<struct<place:int,siblings:array<string>>>"


@dataclass
class Manifest:
    """The levels, leaves first, of the trees of each source (leaves: tree, idx, n, digest, doc_id, carried; nodes above:
    tree, idx, n, digest, children) and those of the tree over the sources' roots. n counts a tree's nodes at the level."""

    documents: list[DataFrame]
    sources: list[DataFrame]

    def root(self) -> str | None:
        """The digest over everything; None for an empty table."""
        top = self.sources[-1].where("n = 1").select("digest").first()
        return top and top[0]


def leaf_digest(**fields: Column) -> Column:
    """The digest of a document's fields; those not given are the columns of their names. Null is -, else bytes, colon, value."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, a row's place in its tree from 0 on, and n, the tree's rows.

    Rows are dealt by ranges of tree and order; places are counted within a range, then over the ranges, so that no task holds a whole tree."""
    dealt = cut(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"))
    upto = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"before": F.coalesce(F.sum("here").over(upto), F.lit(0)), "n": F.sum("here").over(Window.partitionBy("tree"))})
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = dealt.withColumn("within", within).join(per, ["tree", "part"])
    return placed.withColumn("idx", F.col("before") + F.col("within") - 1).drop("part", "here", "before", "within")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The written levels above (and with) numbered leaves: runs of ``ARITY`` become their digest while a tree has several nodes."""
    levels = [cut(leaves, "level0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        run, n = F.floor(F.col("idx") / ARITY).alias("idx"), F.ceil(F.col("n") / ARITY).alias("n")
        runs = levels[-1].where("n > 1").groupBy("tree", run, n).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        runs = runs.withColumn("children", F.transform("run", lambda x: x["digest"]))
        node = runs.select("tree", "idx", "n", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        levels.append(cut(node, f"level{len(levels)}"))
        most = -(-most // ARITY)
    return levels


def build(docs: DataFrame, carry: tuple[str, ...] = ()) -> Manifest:
    """The manifest of documents: doc_id, source, lang, n_chars, text.

    Each row is a leaf, repeated rows and ids included. Within a source, null being one, leaves ascend by doc_id (null
    first, equal ids by leaf); sources ascend bytewise, null first. Nulls in any column and empty texts have their own
    digests; texts of any length are hashed whole; columns in ``carry`` stay beside the leaves as ``carried``, others
    are ignored; an empty table gives trees without nodes. Each level is written and the next one made from it."""
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")).alias("tree")
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried")
    leaves = cut(docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), kept, F.monotonically_increasing_id().alias("tie")), "leaves")
    documents = _levels(_numbered(leaves, ["doc_id", "digest", "tie"]).drop("tie"))
    tops = documents[0].where("n = 1").select("tree", "digest")
    for level in documents[1:]:
        tops = tops.union(level.where("n = 1").select("tree", "digest"))
    roots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return Manifest(documents, _levels(_numbered(cut(roots, "subroots"), ["name"])))


def _pushed(levels: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The leaves with proof and top. ``outer`` (tree, outer) is what a tree's top inherits; a child puts its siblings before its parent's proof."""
    above = None
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at]
        here = level.where("n = 1").join(outer, "tree").withColumns({"proof": F.col("outer"), "top": F.col("digest")}).drop("outer")
        if above is not None:
            parents = above.select(F.col("tree").alias("_tree"), F.col("idx").alias("_run"), F.col("children").alias("_run_digests"), F.col("proof").alias("_above"), F.col("top"))
            met = level.where("n > 1").join(parents, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / ARITY) == F.col("_run")))
            place = (F.col("idx") % ARITY).cast("int")
            siblings = F.concat(F.slice("_run_digests", F.lit(1), place), F.slice("_run_digests", place + 2, F.lit(ARITY)))
            step = F.array(F.struct(place.alias("place"), siblings.alias("siblings")))
            here = here.unionByName(met.withColumn("proof", F.concat(step, F.col("_above"))).select(*level.columns, "proof", "top"))
        above = cut(here, f"proved{at}") if at else here
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof and the carried columns.

    A proof lists, from the leaf up, the place of the node in its run and the digests of the run's others, through the
    source's root to the root. Levels where a node is alone have no siblings; a tree of one leaf has no levels."""
    spark: SparkSession = manifest.documents[0].sparkSession
    nothing = spark.range(1).select(F.lit("").alias("tree"), F.lit(None).cast(PROOF).alias("outer")).withColumn("outer", F.coalesce("outer", F.array().cast(PROOF)))
    sources = cut(_pushed(manifest.sources, nothing).select(F.col("name").alias("tree"), F.col("proof").alias("outer"), F.col("top").alias("root")), "sources")
    found = _pushed(manifest.documents, sources.select("tree", "outer"))
    return found.join(sources.select("tree", "root"), "tree").select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof", "carried")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["place"]), F.slice(step["siblings"], step["place"] + 1, F.lit(ARITY))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, up)
