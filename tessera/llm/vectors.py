"""Embedding near-dedup: coarse inverted lists, residual product codes, table-lookup distances, exact cosine rerank.

Lists to probe and code distances to keep follow from exact bounds, so no link is lost to the index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, ship
from tessera.llm.components import components

#: Bounds of what the driver fits the index on, and of the index itself.
SAMPLE, MOST_LISTS, CODES = 8192, 1024, 256
#: Vectors that a shard's lists hold together, and visitors that meet a shard in one task, about.
SHARD, VISITORS = 2048, 4096
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centre without rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, num=min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that squares don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Index:
    """Centres of the lists and codebooks of the residuals' subspaces, for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        self.centres, self.radius, dim = _kmeans(sample, lists), radius, sample.shape[1]
        parts = max(p for p in range(1, min(8, dim) + 1) if dim % p == 0)
        self.width = dim // parts
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_kmeans(rest[:, i : i + self.width], CODES, 4) for i in range(0, dim, self.width)]
        self.apart = np.sqrt(_distances(self.centres, self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: list, codes, error of what the codes give back, and the lists that may hold a neighbour.

        A neighbour within the radius lies on its list's side of the plane between two centres, so a list counts if
        that plane is within the radius."""
        squares = _distances(x, self.centres)
        own = squares.argmin(1)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, i * self.width : (i + 1) * self.width], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)
        error = np.sqrt(((rest - self.rest(codes)) ** 2).sum(1))
        gap = squares - squares[np.arange(len(x)), own][:, None]
        probed = gap <= 2 * self.apart[own] * (self.radius + _SLACK) + _SLACK
        return own, codes, error, probed

    def rest(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def looked_up(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of vectors ``x`` to what ``codes`` in lists ``own`` give back, by a table for each vector."""
        rest, centres = self.rest(codes), self.centres[own]
        fixed = (rest * rest).sum(1) + 2 * (rest * centres).sum(1)
        out = _distances(x, self.centres)[:, own] + fixed[None]
        for i, b in enumerate(self.books):
            table = x[:, i * self.width : (i + 1) * self.width] @ b.T
            out -= 2 * table[:, codes[:, i]]
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _pairs(index: Index, x: pd.DataFrame, y: pd.DataFrame, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs, some rows of ``x`` at a time; of one frame with itself, each pair once."""
    xs, ys = _matrix(x["raw"]), _matrix(y["raw"])
    ux, uy = unit(xs), unit(ys)
    own, codes = y["list"].to_numpy(), np.frombuffer(b"".join(y["codes"]), dtype=np.uint8).reshape(len(y), -1)
    reach = (index.radius + y["error"].to_numpy() + _SLACK) ** 2 + _SLACK
    for at in range(0, len(x), 256):
        q = ux[at : at + 256]
        probed = index.encode(q)[3][:, own]
        a, b = np.nonzero(probed & (index.looked_up(q, own, codes) <= reach[None]))
        a += at
        if same:
            a, b = a[a < b], b[a < b]
        cosine = (ux[a] * uy[b]).sum(1)
        yield a[cosine >= least], b[cosine >= least]


def _compare(index: Index, base: pd.DataFrame, visitors: pd.DataFrame, inner: bool, least: float) -> pd.DataFrame:
    """Links of a shard's vectors with its visitors and, if ``inner``, with one another: counts, and a spanning forest."""
    nodes = np.concatenate([base["node"].to_numpy(), visitors["node"].to_numpy()])
    copies = np.concatenate([base["copies"].to_numpy(), visitors["copies"].to_numpy()])
    order = np.argsort(nodes, kind="stable")
    label, counts = np.empty(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    label[order] = np.arange(len(nodes))  # ranks of the nodes, so that the least is the least node
    runs = [(_pairs(index, visitors, base, False, least), len(base))] if len(visitors) else []
    runs += [(_pairs(index, base, base, True, least), 0)] if inner else []
    for pairs, shift in runs:
        for a, b in pairs:
            a = a + shift
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
            while True:
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, order[label[a]], low)
                np.minimum.at(label, order[label[b]], low)
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                label = label[order[label]]
                if (before == label).all():
                    break
    linked = counts > 0
    return pd.DataFrame({"node": nodes[linked], "links": counts[linked], "root": nodes[order[label]][linked]})


def _classes(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) with what tells equal vectors of a label: two hashes; null for those that link with nothing."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    key = F.when(F.coalesce(good & F.col("label").isNotNull(), F.lit(False)), F.struct(F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")))
    return vectors.select("vec_id", "label", x.cast("array<double>").alias("embedding")).withColumn("key", key)


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id, kept, one row a vector.

    Vectors of the same label and dimension are linked if their cosine in double precision is ``least`` or more;
    vectors that are null, zero or hold null or non-finite components, and those without label, link with nothing.
    Equal vectors of a label are compared once and counted as often as they occur. The index is fitted on at most
    ``SAMPLE`` vectors a dimension, the first by hash, and holds all; lists are probed and codes kept by exact bounds.
    n_links counts other vectors linked directly, component_id is the least vec_id reached, kept says that it is the
    vector's own; a row without id takes part and is kept if nothing it reaches has one. Other columns are ignored."""
    ship(vectors.sparkSession)
    rows = _classes(vectors)
    narrow = cut(rows.select("vec_id", "key"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    classes = cut(classes.select("key", "label", F.size("embedding").alias("dim"), "embedding", "copies", F.monotonically_increasing_id().alias("node")), "classes")
    found = [_linked(classes.where(F.col("dim") == d), d, n, least) for d, n in sorted(tuple(x) for x in classes.groupBy("dim").count().collect())]
    pairs = None
    for x in found:
        pairs = x if pairs is None else pairs.union(x)
    if pairs is None:
        pairs = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    pairs = cut(pairs, "links")
    counts = cut(pairs.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    labels = components(pairs.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "copies", "node").join(counts, "node", "left").join(labels, "node", "left")
    named = cut(named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    members = cut(narrow.where("key IS NOT NULL").join(named, "key").select("vec_id", "n_links", "component"), "members")
    ids = cut(members.groupBy("component").agg(F.min("vec_id").alias("component_id")), "ids")
    out = members.join(ids, "component").select("vec_id", "n_links", "component_id")
    out = out.union(narrow.where("key IS NULL").select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _linked(classes: DataFrame, dim: int, n: int, least: float) -> DataFrame:
    """(node, links, root): links found in some task, with the least node it reaches there."""
    spark = classes.sparkSession
    sample = classes.select("embedding").orderBy(F.xxhash64("key"), "node").limit(SAMPLE).toPandas()["embedding"]
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    index = Index(unit(np.array(sample.tolist(), dtype=np.float64)), min(MOST_LISTS, max(1, round(math.sqrt(n) / 4))), radius)
    shared = spark.sparkContext.broadcast(index)

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = np.array(part["embedding"].tolist(), dtype=np.float64)
            if not len(raw):
                continue
            own, codes, error, probed = shared.value.encode(unit(raw))
            yield pd.DataFrame({"node": part["node"], "label": part["label"], "copies": part["copies"], "raw": [x.tobytes() for x in raw], "list": own, "codes": [x.tobytes() for x in codes], "error": error, "probed": [np.flatnonzero(x) for x in probed]})

    label = classes.schema["label"].dataType.simpleString()
    schema = f"node long, label {label}, copies long, raw binary, list int, codes binary, error double, probed array<int>"
    coded = cut(classes.select("node", "label", "copies", "embedding").mapInPandas(encoded, schema), "coded")
    # lists in a row make shards of about SHARD vectors; a longer list is dealt over several shards
    cells = coded.groupBy("label", "list").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("list")) - F.col("n")
    cells = cut(cells.withColumn("first", F.floor(upto / SHARD)).withColumn("shards", F.ceil(F.col("n") / SHARD)).select("label", "list", "first", "shards"), "cells")
    home = coded.join(cells, ["label", "list"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("node"), F.col("shards")))
    home = cut(home.drop("first", "shards"), "home")
    visits = home.select("node", "label", "shard", F.explode("probed").alias("list")).withColumnRenamed("shard", "from").join(cells, ["label", "list"])
    visits = visits.select("node", "label", "from", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard")).where("shard > from").select("node", "label", "shard").distinct()
    visits = cut(visits, "visits")
    tables = cut(visits.groupBy("label", "shard").agg(F.ceil(F.count("*") / VISITORS).alias("tables")), "tables")
    values = ["node", "copies", "raw", "list", "codes", "error"]
    hosts = home.select("label", "shard", *values).join(tables, ["label", "shard"], "left")
    hosts = hosts.withColumn("table", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tables", F.lit(1)) - 1))).withColumn("host", F.lit(True))
    guests = visits.join(tables, ["label", "shard"]).withColumn("table", F.pmod(F.xxhash64("node"), F.col("tables"))).join(home.select(*values), "node").withColumn("host", F.lit(False))
    columns = ["label", "shard", "table", "host", *values]

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        return _compare(shared.value, frame[frame["host"]], frame[~frame["host"]], bool(frame["table"].iloc[0] == 0), least)

    return hosts.select(*columns).union(guests.select(*columns)).groupBy("label", "shard", "table").applyInPandas(compared, "node long, links long, root long")
