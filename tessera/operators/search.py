"""Exact retrieval: dense and BM25 ranking, fusion of ranked lists, and how well a ranking finds what it should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked(scores: DataFrame, by: list[str], k: int | None = None, tie: str | list[str] = "vec_id", score: str = "score") -> DataFrame:
    """Adds rank from 1 by descending score, ties by ``tie``; keeps k a list. Spark keeps k a partition before the shuffle."""
    ties = [tie] if isinstance(tie, str) else tie
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)))
    return out.where(F.col("rank") <= k) if k else out


#: Queries that are broadcast together, at most; more are dealt into blocks of so many.
BLOCK = 1024


def met(queries: DataFrame, items: DataFrame, where: Column) -> DataFrame:
    """Every query (query_id) with every item (vec_id) that its condition lets through.

    Up to ``BLOCK`` queries are broadcast. More are dealt into blocks and items into slices; a block meets a slice in one task."""
    n = queries.count()
    if n <= BLOCK:
        return items.join(F.broadcast(queries), where)
    blocks, slices = -(-n // BLOCK), 4 * items.sparkSession.sparkContext.defaultParallelism
    own = lambda col, m: F.pmod(F.xxhash64(col), F.lit(m))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.withColumn("_b", own("query_id", blocks)).withColumn("_s", each(slices))
    i = items.withColumn("_s", own("vec_id", slices)).withColumn("_b", each(blocks))
    return i.join(q, ["_b", "_s"]).where(where)


#: Queries of a block and items of a slice that meet in one task, about; and queries that are scored at once.
CELL_QUERIES, CELL_ITEMS, AT_ONCE = 8192, 16384, 256


def _regular(vector: str, size: int) -> Column:
    """Is a vector of that size and of components that no product overflows?"""
    own = F.forall(vector, lambda x: x.isNotNull() & F.coalesce(F.abs(x.cast("double")) < 1e100, F.lit(False)))
    return F.coalesce((F.size(vector) == size) & own, F.lit(False))


def contenders(queries: DataFrame, items: DataFrame, k: int, by: list[str] = (), same: list[str] = ()) -> DataFrame:
    """(query_id, q), (vec_id, v) with long ids to (query_id, vec_id, *by, score): all pairs that may be among a query's k best
    of each group of ``by`` (columns of items), by inner product rounded to 6 decimals, ties by vec_id; and others.

    An item counts for a query if it is another one and, for each x of ``same``, q_x of the query is null or equal to x.
    Blocks of queries meet slices of items, each pair in one task, where matrix products leave out what lies more than a
    rounding step and the products' own error below the k-th; the rest is summed in double precision, left to right, and
    of equal sums the k least ids stay. Vectors of another size or with null or huge components meet all others in a join."""
    size, n = queries.agg(F.coalesce(F.max(F.size("q")), F.lit(0)), F.count("*")).first()
    good_q, good_i = _regular("q", size), _regular("v", size)
    odd_q = queries.where(~good_q).count()
    m, odd_i = items.agg(F.count("*"), F.count_if(~good_i)).first()
    blocks, slices = max(1, -(-n // CELL_QUERIES)), max(1, -(-m // CELL_ITEMS))
    own = lambda col, parts: F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")  # noqa: E731  as in each: a cogroup casts no keys, and an int and a long of one value are dealt apart
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.where(good_q).select("query_id", "q", *[f"q_{x}" for x in same], own("query_id", blocks).alias("_b")).withColumn("_s", each(slices))
    i = items.where(good_i).select("vec_id", "v", *by, *same, own("vec_id", slices).alias("_s")).withColumn("_b", each(blocks))
    names, filters, most = list(by), list(same), AT_ONCE

    def cell(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks] or [np.zeros(0)])
            return flat.astype(np.float64).reshape(len(column), size)

        vectors, points = matrix(left.column("q")), matrix(right.column("v"))
        asked, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        tags = list(zip(*[right.column(x).to_pylist() for x in names])) if names else [()] * len(ids)
        group = {t: j for j, t in enumerate(dict.fromkeys(tags))}
        of = np.array([group[t] for t in tags], dtype=np.int64)
        codes = []
        for x in filters:
            seen = {}
            mine = np.array([-1 if y is None else seen.setdefault(y, len(seen)) for y in right.column(x).to_pylist()], dtype=np.int64)
            codes.append((np.array([-2 if y is None else seen.get(y, -3) for y in left.column(f"q_{x}").to_pylist()], dtype=np.int64), mine))
        reach = np.sqrt((vectors * vectors).sum(axis=1))
        out = []
        for tag, number in group.items():
            at = np.nonzero(of == number)[0]
            near, far = points[at], ids[at]
            slack = 1.5e-6 + 1e-14 * (size + 1) * reach * np.sqrt((near * near).sum(axis=1).max())
            for start in range(0, len(asked), most):
                part = slice(start, start + most)
                scores = vectors[part] @ near.T
                out_of = asked[part][:, None] == far[None, :]
                for want, have in codes:
                    out_of |= (want[part] != -2)[:, None] & (want[part][:, None] != have[at][None, :])
                scores[out_of] = -np.inf
                least = np.full(len(scores), -np.inf)
                if len(at) > k:
                    least = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] - slack[part]
                r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                exact = np.zeros(len(r))
                for d in range(size):
                    exact += vectors[start + r, d] * near[c, d]
                order = np.lexsort((far[c], -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                new = np.ones(len(r), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (exact[1:] != exact[:-1])
                first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
                keep = np.arange(len(r)) - first < k
                r, c, exact = r[keep], c[keep], exact[keep]
                out.append(pa.table({"query_id": asked[start + r], "vec_id": far[c], **{x: pa.array([tag[j]] * len(r), type=right.schema.field(x).type) for j, x in enumerate(names)}, "score": exact}))
        kinds = {x: right.schema.field(x).type for x in names}
        return pa.concat_tables(out) if out else pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), *kinds.items(), ("score", pa.float64())]).empty_table()

    schema = ", ".join(["query_id long", "vec_id long", *[f"{x} {items.schema[x].dataType.simpleString()}" for x in names], "score double"])
    found = q.groupBy("_b", "_s").cogroup(i.groupBy("_b", "_s")).applyInArrow(cell, schema)
    passes = F.col("query_id") != F.col("vec_id")
    for x in filters:
        passes = passes & (F.col(f"q_{x}").isNull() | F.col(f"q_{x}").eqNullSafe(F.col(x)))
    score = dot(F.col("q"), F.col("v")).alias("score")
    if odd_q:
        found = found.unionByName(met(queries.where(~good_q), items, passes).select("query_id", "vec_id", *names, score))
    if odd_i:
        found = found.unionByName(met(queries.where(good_q), items.where(~good_i), passes).select("query_id", "vec_id", *names, score))
    return found


def dense_topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, q) against (vec_id, v): the k best by inner product, the query's own row left out."""
    return ranked(contenders(queries, items, k).withColumn("score", F.round("score", 6)), ["query_id"], k)


#: Terms of queries that are broadcast, at most; a query's own count for each.
TERMS = 200_000


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(doc_id, text), (query_id, question) to query_id, doc_id, score: Okapi BM25, negative idf replaced by ``floor`` of the mean.

    A query term counts as often as it is asked; a doc_id is one row's. Documents are dealt by doc_id once; their terms,
    scores and a window's cut by query then stay in the task. Up to ``TERMS`` terms that are asked are broadcast, with the
    queries that ask them; more are joined by term."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    length = words.select("doc_id", F.greatest(F.size("ts"), F.lit(0)).cast("long").alias("dl"))
    stats = length.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))  # one row
    df = words.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = asked.count() <= TERMS
    sent = F.broadcast if few else (lambda x: x)
    wanted = sent(asked.select("term").distinct())
    own = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", tokens(F.col("text")).alias("ts"))
    tf = own.select("doc_id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = tf.join(sent(asked.join(idf, "term")), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def reciprocal_rank_fusion(lists: DataFrame, constant: int = 60, weight: str | None = None) -> DataFrame:
    """(query_id, item, rank[, weight]) to query_id, item, score: sums of weight / (constant + rank) over the lists."""
    w = F.col(weight) if weight else F.lit(1.0)
    return lists.groupBy("query_id", "item").agg(F.round(F.sum(w / (constant + F.col("rank"))), 9).alias("score"))


def min_max(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Adds norm, the score between its list's least (0) and greatest (1); 1 for all if these are equal."""
    w = Window.partitionBy(*by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return scores.withColumn("norm", F.round(F.when(span == 0, 1.0).otherwise((F.col(score) - F.min(score).over(w)) / F.nullif(span, F.lit(0.0))), 6))


def retrieval_quality(ranking: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """(query_id, item, rank), (query_id, expected): questions, recall at k and mean reciprocal rank; an absent item counts 0."""
    right = ranking.join(golden, (ranking["query_id"] == golden["query_id"]) & (ranking["item"] == golden["expected"])).groupBy(golden["query_id"]).agg(F.min("rank").alias("rank"))
    per = golden.select("query_id").distinct().join(right, "query_id", "left")
    return per.agg(F.count("*").alias("questions"), F.round(F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def context(ranking: DataFrame) -> DataFrame:
    """(query_id, rank, number, title, text) to one block of text a query, in rank order."""
    block = F.format_string("[Article %d - %s]\n%s\n", F.col("number"), F.col("title"), F.col("text"))
    return ranking.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n").alias("context"))
