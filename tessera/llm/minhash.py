"""MinHash near-dedup: fast similarity sketches, banding, and confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, may_hold, ship
from tessera.llm.linking import forest, link, scored, with_leaders

#: Bands of rows. At a Jaccard similarity of 0.85 a pair shares no band with probability below 1e-6, at 0.8 below 1e-4.
BANDS, ROWS = 24, 5
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function, wrapping around; ``salt`` selects one of a family."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode().lower()


def word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word, words being cut at ASCII white space. ``known`` holds hashes already made."""
    import xxhash

    words = text.split()
    if len(known) > 500_000:
        known.clear()
    known.update((w, xxhash.xxh64_intdigest(w)) for w in {w for w in words if w not in known})
    return np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))


def shingles(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted set of a text's ``width``-word shingles as 64-bit hashes; of fewer words, the whole as one."""
    hashes = word_hashes(lower_ascii(text or ""), known)
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    out = _mix(hashes[: n - w + 1], w)
    for i in range(1, w):
        out = _mix(out ^ hashes[i : n - w + 1 + i], i)
    return np.unique(out)


def fast_sketch(items: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketching of a set of 64-bit hashes; equal coordinates of two sets are as likely as their similarity.

    In round i each item goes to a hashed bin with the value i plus a hashed fraction, and in the rounds past
    ``coordinates`` to bin i - ``coordinates``, so that every bin fills; a bin keeps its least value. Rounds end when all
    bins are filled."""
    sketch = np.full(coordinates, np.inf)
    for i in range(2 * coordinates):
        h = _mix(items, i + 1)
        if i < coordinates:
            bins = ((h >> _U(40)) % _U(coordinates)).astype(np.int64)
            np.minimum.at(sketch, bins, i + (h & _U(0xFFFFFFFFFF)).astype(np.float64) / float(1 << 40))
        else:
            sketch[i - coordinates] = min(sketch[i - coordinates], i + float((h & _U(0xFFFFFFFFFF)).min()) / float(1 << 40))
        if np.isfinite(sketch).all():
            break
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of ``rows`` coordinates."""
    parts = sketch.view(_U).reshape(bands, rows)
    out = _mix(np.arange(bands, dtype=_U), 77)
    for i in range(rows):
        out = _mix(out ^ parts[:, i], i)
    return out.view(np.int64)


def sketch_bytes(sketch: np.ndarray) -> bytes:
    """A byte of each coordinate; those of unequal coordinates are equal once in 256 times."""
    return (_mix(sketch.view(_U), 78) >> _U(56)).astype(np.uint8).tobytes()


def least_agreement(percent: int, coordinates: int) -> int:
    """Coordinates that two sets of similarity ``percent`` have in common at least: the mean less six deviations.

    A pair has fewer with probability below 1e-7, so what this rules out needs no comparing of full sets."""
    p = percent / 100
    return math.floor(coordinates * p - 6 * math.sqrt(coordinates * p * (1 - p)))


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text) to doc_id, the text's hash and length, n_shingles, the set's digest in two longs, its band keys and a byte of each coordinate.

    Empty sets have neither keys nor bytes."""
    ship(docs.sparkSession)
    schema = "doc_id string, th long, size int, n_shingles long, hi long, lo long, bands array<long>, sig binary"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[bytes, int] = {}
        for part in parts:
            out = []
            for text in part["text"]:
                found = shingles(text if isinstance(text, str) else None, width, known)
                digest = np.frombuffer(xxhash.xxh128_digest(found.tobytes()), dtype=np.int64)
                sketch = fast_sketch(found, bands * rows) if len(found) else None
                keys, sig = (None, None) if sketch is None else (band_keys(sketch, bands, rows), sketch_bytes(sketch))
                out.append((len(found), digest[0], digest[1], keys, sig))
            made = pd.DataFrame(out, columns=["n_shingles", "hi", "lo", "bands", "sig"], index=part.index)
            yield pd.concat([part[["doc_id", "th", "size"]], made], axis=1)

    out = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *_text_key(), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _text_key() -> list:
    """What finds a text again: its hash and its length."""
    return [F.xxhash64("text").alias("th"), F.coalesce(F.char_length("text"), F.lit(0)).alias("size")]


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), -1)


def _confirm(used: DataFrame, texts: DataFrame, width: int, percent: int, least: int):
    """Confirms pairs of nodes on the full sets of their texts.

    ``used`` is (node, n_shingles, sig), ``texts`` (node, text). Pairs whose sketches agree in fewer than ``least``
    coordinates, or whose sizes differ too much, are ruled out before any text is moved."""

    def alike(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.loc[(_matrix(part["_x"]) == _matrix(part["_y"])).sum(axis=1) >= least, ["u", "v"]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        last, sets = None, None
        for part in parts:
            keep = []
            for u, a, b in zip(part["u"], part["a"], part["b"], strict=True):
                if u != last:
                    last, sets = u, shingles(a, width, known)
                other = shingles(b, width, known)
                both = len(np.intersect1d(sets, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(sets) + len(other) - both))
            yield part.loc[keep, ["u", "v"]]

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(used.toDF("u", "_n", "_x"), "u").join(used.toDF("v", "_m", "_y"), "v")
        near = near.where(100 * F.least("_n", "_m") >= percent * F.greatest("_n", "_m"))
        near = cut(near.select("u", "v", "_x", "_y").mapInPandas(alike, "u long, v long"), "pairs")
        full = near.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        return full.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")

    return confirm


def _confirm_blocks(used: DataFrame, texts: DataFrame, width: int, percent: int, least: int):
    """Confirms the pairs of blocks: intersections are a product of 0/1 matrices over the shingles both sides have.

    Only members whose sketch agrees with that of one across in ``least`` coordinates get their texts."""

    def alike(frame: pd.DataFrame) -> pd.DataFrame:
        sigs, sizes, comp = _matrix(frame["sig"]), frame["n_shingles"].to_numpy(), frame["comp"].to_numpy()
        guest = frame["guest"].to_numpy()
        rows, hosts = np.flatnonzero(guest), np.flatnonzero(~guest)
        keep = np.zeros(len(frame), dtype=bool)
        for at in range(0, len(rows), 32):
            few = rows[at : at + 32]
            near = (sigs[few][:, None] == sigs[hosts][None]).sum(axis=2, dtype=np.int32) >= least
            small, large = np.minimum(sizes[few][:, None], sizes[hosts][None]), np.maximum(sizes[few][:, None], sizes[hosts][None])
            near &= (comp[few][:, None] != comp[hosts][None]) & (100 * small >= percent * large)
            keep[few] |= near.any(axis=1)
            keep[hosts] |= near.any(axis=0)
        return frame.loc[keep, ["bucket", "i", "j", "node", "comp", "guest"]]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        sets = [shingles(t, width, known) for t in frame["text"]]
        guest, comp = frame["guest"].to_numpy(), frame["comp"].to_numpy()
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        rows, hosts = np.flatnonzero(guest), np.flatnonzero(~guest)
        if not len(rows) or not len(hosts):
            return forest(np.zeros(0, np.int64), np.zeros(0, np.int64))
        owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        values, code, count = np.unique(items, return_inverse=True, return_counts=True)
        both = np.zeros((len(rows), len(hosts)), dtype=np.float32)
        at = np.zeros(len(sets), dtype=np.int64)
        at[rows], at[hosts] = np.arange(len(rows)), np.arange(len(hosts))
        keep = (count > 1)[code]
        owner, code = owner[keep], code[keep]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        # some shingles at a time, so that the matrices stay small whatever the texts' length
        step = 4096
        for low in range(0, len(values), step):
            a, b = np.searchsorted(code, [low, low + step])
            if a == b:
                continue
            o, k = owner[a:b], code[a:b] - low
            x, y = np.zeros((len(rows), step), dtype=np.float32), np.zeros((len(hosts), step), dtype=np.float32)
            g = guest[o]
            x[at[o[g]], k[g]] = 1
            y[at[o[~g]], k[~g]] = 1
            both += x @ y.T
        union = sizes[rows][:, None] + sizes[hosts][None] - both
        linked = (100 * both >= percent * union) & (comp[rows][:, None] != comp[hosts][None])
        i, j = np.nonzero(linked)
        return forest(comp[rows][i], comp[hosts][j])

    def confirm(blocks: DataFrame) -> DataFrame:
        likely = blocks.join(used, "node").groupBy("bucket", "i", "j").applyInPandas(alike, "bucket long, i long, j long, node long, comp long, guest boolean")
        full = cut(likely, "likely").join(texts.select("node", "text"), "node")
        return full.groupBy("bucket", "i", "j").applyInPandas(run, "u long, v long")

    return confirm


def classes_and_components(docs: DataFrame, width: int, percent: int, bands: int, rows_a_band: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, one row a document, and (hi, lo, component): each class of equal sets with its component."""
    sketches = cut(sketched(docs, width, bands, rows_a_band), "sketches")
    first = F.min(F.struct("doc_id", "th", "size", "n_shingles", "bands", "sig")).alias("_r")
    classes = sketches.where("n_shingles > 0").groupBy("hi", "lo").agg(first).select("hi", "lo", "_r.*")
    # ids of their own: documents may share an id, or have none
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    held = with_leaders(scored(cut(keys.distinct(), "keys")))
    # one row of a class gives its text; a bitmap spares the texts of others the shuffle
    row = F.xxhash64("doc_id", "th", "size").alias("row")
    used = cut(classes.join(held.select("node").distinct(), "node").select("node", "n_shingles", "sig", "th", row), "used")
    there = may_hold(used, "row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(), "text").select("th", row, "text")
    rows = rows.where(F.lit(False) if there is None else there)
    texts = cut(rows.join(used.select("node", "th", "row"), ["row", "th"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    used, least = used.select("node", "n_shingles", "sig"), least_agreement(percent, bands * rows_a_band)
    linked = link(held, _confirm(used, texts, width, percent, least), _confirm_blocks(used, texts, width, percent, least))
    named = classes.join(linked, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    return sketches, cut(named, "named")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Documents (doc_id, text) to doc_id, n_shingles, component_id, kept.

    Sets are of distinct ``width``-word shingles of the text in lower case (A-Z); shorter texts are one shingle, texts
    without words (or null) none, and these link with nothing. Two documents are linked if
    100 * intersection >= ``percent`` * union. Equal sets form a class, of which one text is compared; classes that
    share a band of their fast similarity sketches are candidates, confirmed on full sets where the sketches agree enough. component_id is the least
    doc_id reached, kept says that it is the document's own. Rows with equal ids stay apart but share the id; a row
    without id takes part, gets its component's least id, and is kept only if that is null. Other columns are
    ignored; an empty table gives no rows."""
    sketches, named = classes_and_components(docs, width, percent, bands, rows)
    full = cut(sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "n_shingles", "component"), "members")
    ids = cut(full.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    out = full.join(ids, "component").select("doc_id", "n_shingles", "component_id")
    out = out.union(sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents, one of each component: the one of least doc_id (null last), then of least text hash.

    Documents without words link with nothing and all stay; of repeated rows that would stay, one does."""
    sketches, named = classes_and_components(docs, width, percent, bands, rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "size")
    members = sketches.where("n_shingles > 0").select("doc_id", "th", "size", "hi", "lo").join(named, ["hi", "lo"])
    best = members.groupBy("component").agg(F.min(rank).alias("_r")).select(F.col("_r.doc_id").alias("_id"), F.col("_r.th").alias("_th"), F.col("_r.size").alias("_size"))
    empty = sketches.where("n_shingles = 0").select("doc_id", "th", "size").distinct()
    best = cut(best.union(empty), "best")
    key, size = _text_key()
    wide = docs.withColumns({"_t_id": F.col("doc_id").cast("long"), "_t_th": key, "_t_size": size})
    same = (F.col("_t_th") == F.col("_th")) & (F.col("_t_size") == F.col("_size")) & F.col("_t_id").eqNullSafe(F.col("_id"))
    chosen = wide.join(best, same)
    return chosen.dropDuplicates(["_t_id", "_t_th", "_t_size"]).select(*[F.col(f"`{c}`") for c in docs.columns])
