"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, word_count

#: Points of the schedule are bit-reversed counters of so many bits.
BITS = 40


def _point(k: Column) -> Column:
    """The k-th van der Corput point in base 2, times 2^BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(k), BITS, "0")), 2, 10).cast("long")


def _order_key() -> Column:
    """By this the documents of a source are shuffled; those without id by their text, so that they don't fall together."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, words) to sid, weight, target: shares of all words by weight, capped at ``cap`` times a source's words.

    What a cap cuts off is shared again by weight: with sources in order of cap over weight, the level that each
    would give the rest rises while sources are capped and falls from then on, so its peak holds. One row a source: a recipe lists its sources."""
    w = F.lit([float(x) for x in weights])
    ranked = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", w[(F.col("sid") % len(weights))]).withColumn("most", F.col("words") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    final = F.max("level").over(everything)
    return ranked.withColumn("target", F.least("most", final * F.col("weight"))).select("source", "sid", "words", "n", "weight", "target")


def _demands(sources: DataFrame, block_words: int) -> DataFrame:
    """Adds need (words), blocks in the source's stream and the slots it needs: whole passes, then a part."""
    need = F.floor(F.col("target") + 0.5)
    words = F.col("words")
    df = sources.withColumn("need", F.when(words > 0, need).otherwise(0)).withColumn("blocks", F.ceil(words / block_words))
    whole = F.when(words > 0, F.floor(F.col("need") / F.greatest(words, F.lit(1)))).otherwise(0)
    df = df.withColumn("rest", F.col("need") - whole * words)
    df = df.withColumn("slots", whole * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0)))


def schedule(sources: DataFrame, chunk: int = 4096) -> DataFrame:
    """(sid, rank, slot): one row for each slot a source needs, slots dealt by points mapped through the cumulative weights.

    Slots are the places of the mix, in its order. Ranks are counted in chunks of slots, then over the chunks, so no
    task holds all slots of a source. Points miss a source's share by a few slots at most; surplus ranks go, missing
    ones are appended past the last slot."""
    spark = sources.sparkSession
    n, most = sources.agg(F.sum("slots"), F.count("*")).first()
    n, cells = int(n or 0), max(1024, 2 * most)
    scale = float(2**BITS)
    lo, hi = F.col("first") / max(n, 1) * scale, (F.col("first") + F.col("slots")) / max(n, 1) * scale
    cell = lambda x: F.least(F.floor(x / scale * cells), F.lit(cells - 1))
    spans = sources.where("slots > 0").withColumn("lo", lo).withColumn("hi", hi).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select("sid", "lo", "hi", "cell", "slots")
    parts = max(1, math.ceil(n / (64 * chunk)))
    points = spark.range(0, n, 1, parts).withColumn("x", _point(F.col("id"))).withColumn("cell", cell(F.col("x")))
    dealt = points.join(spans, "cell").where("x >= lo AND x < hi").select("sid", "id", "slots", F.floor(F.col("id") / chunk).alias("chunk"))
    per = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("here"))
    per = per.withColumn("before", F.coalesce(F.sum("here").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1
    ranked = dealt.withColumn("local", local).join(per, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.col("local")).where("rank < slots").select("sid", "rank", F.col("id").alias("slot"))
    had = per.groupBy("sid").agg(F.sum("here").alias("had"))
    short = sources.select("sid", "slots", "first").join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    more = short.select("sid", "first", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank"))
    return ranked.union(more.select("sid", "rank", (n + F.col("first") + F.col("rank")).alias("slot")))


def block_takes(sources: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """(sid, block, whole, part, at, at_part): how often the mix takes a block, the words of a last, cut one, and their first slots."""
    df = slots.join(sources.select("sid", "blocks", "slots", "rest"), "sid")
    df = df.withColumn("block", F.col("rank") % F.col("blocks"))
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    df = df.withColumn("cut", F.when(last, F.col("rest") - F.col("block") * block_words))
    return df.groupBy("sid", "block").agg(F.count(F.when(~last, 1)).alias("whole"), F.coalesce(F.max("cut"), F.lit(0)).alias("part"), F.min(F.when(~last, F.col("slot"))).alias("at"), F.min(F.when(last, F.col("slot"))).alias("at_part"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block_words: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents (doc_id, text, source) with the words a mix takes of each.

    Sources in code-point order, null last, get ``weights`` in turn. Each source's documents, shuffled by a hash of
    doc_id, form a stream that is cut into blocks of ``block_words``; van der Corput points mapped through the
    cumulative weights give each slot to a source, and a source's r-th slot takes its block r, round and round.
    Returns doc_id, size, source_size, target, taken, first_slot (the first of the mix's slots that takes words of it;
    null if none does), n_slots (slots that do) and the columns in ``carry``. Null or blank texts have size 0 and take
    0; a null doc_id is shuffled by its text; equal rows (ties) may swap places; texts of any length are counted whole;
    other columns are ignored; an empty table gives no rows."""
    kept = [F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)]
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order_key().alias("key"), *kept), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = cut(_demands(source_targets(totals, weights, cap), block_words).coalesce(1), "sources")
    n = sources.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.isqrt(n))
    keyed = sized.join(sources.select("source", "sid", "words", "target"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("here"))
    sums = sums.select("sid", "bucket", (F.sum("here").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("here")).alias("base"))
    narrow = ["doc_id", "size", "words", "target", "sid", "start"]
    within = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("run", F.sum("size").over(within) - F.col("size")).join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("run"))
    if carry:
        placed = cut(placed.select(*narrow, *[f"_c_{i}" for i in range(len(carry))]), "placed")
    takes = block_takes(sources, schedule(sources), block_words)
    pieces = placed.select(*narrow).where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    begin, end = F.greatest(F.col("start"), F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    rest = F.greatest(F.lit(0), F.least(end, F.col("block") * block_words + F.coalesce("part", F.lit(0))) - begin)
    words, slots = F.coalesce("whole", F.lit(0)) * (end - begin) + rest, F.coalesce("whole", F.lit(0)) + F.when(rest > 0, 1).otherwise(0)
    of = pieces.join(takes, ["sid", "block"], "left").withColumns({"took": words, "slots": slots, "slot": F.least("at", F.when(rest > 0, F.col("at_part")))})
    took = of.groupBy(*narrow).agg(F.sum("took").alias("taken"), F.min("slot").alias("first_slot"), F.sum("slots").alias("n_slots"))
    out = [F.col("doc_id"), F.col("size"), F.col("words").alias("source_size"), F.col("target"), *[F.col(c).cast("long").alias(c) for c in ("taken", "first_slot", "n_slots")]]
    if carry:
        got = took.select("sid", "start", "size", "taken", "first_slot", "n_slots").where("taken > 0")
        return placed.join(got, ["sid", "start", "size"], "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "n_slots": F.coalesce("n_slots", F.lit(0))}).select(*out, *[F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry)])
    nothing = {"taken": F.lit(0), "first_slot": F.lit(None), "n_slots": F.lit(0)}
    return took.select(*out).union(keyed.where("size = 0").withColumns(nothing).select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with their own columns: each as often as its words are taken, rounded half up."""
    names = docs.columns
    carried = docs.toDF(*[f"_d_{i}" for i in range(len(names))])
    ids = {c: F.col(f"_d_{names.index(c)}") for c in ("doc_id", "source", "text")}
    df = carried.withColumns(ids)
    taken = mix(df, carry=tuple(f"_d_{i}" for i in range(len(names))), **options)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    repeated = taken.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*[F.col(f"_d_{i}").alias(c) for i, c in enumerate(names)])
