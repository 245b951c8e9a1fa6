"""Quality classifier by co-training: a text view and a metadata view teach each other, then are calibrated and combined."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, ship

#: Most labelled rows that the driver fits on, the first by hash of doc_id.
LABELLED = 4000
#: Rounds of exchange, pseudo-labels a view gives of each class in a round, and the calibrated confidence they need.
ROUNDS, GIVEN, CONFIDENT = 3, 200, 0.95
SOURCES, LANGS, WORDS = 32, 8, 256


def spreads(rows: int) -> tuple[np.ndarray, float]:
    """Spreads of the views' features: slots of words are many and thinly filled, so they weigh little, and less the fewer rows teach them."""
    words = 10 * max(1.0, LABELLED / max(1, rows)) ** 0.5
    return np.concatenate([np.ones(256), np.full(WORDS, words), np.ones(8)]), 1.0


def text_features(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Of the whole text: shares of byte values and of hashed words (square roots), and ratios of words, lines and cases.

    ``known`` holds the slots of words met before."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(raw))
    words = raw.split()
    different = set(words)
    if len(known) > 200_000:
        known.clear()
    known.update((w, zlib.crc32(w.lower()) % WORDS) for w in different if w not in known)
    slots = np.bincount(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)), minlength=WORDS)
    k, lines = max(1, len(words)), raw.split(b"\n")
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    letters = upper + lower + counts[128:].sum()
    extra = [len(raw) / k / 10, len(different) / k, len(set(lines)) / len(lines), upper / max(1, upper + lower), letters / n, counts[48:58].sum() / n, min(1.0, k / 100), k / n * 5]
    return np.concatenate([np.sqrt(counts / n), np.sqrt(slots / k), extra])


def _slot(value: object, slots: int) -> np.ndarray:
    out = np.zeros(slots)
    if isinstance(value, str):
        out[zlib.crc32(value.encode()) % slots] = 1
    return out


def meta_features(lang: object, source: object, n_chars: object) -> np.ndarray:
    """Of the page's metadata, without its text: language, source, and length as the table has it."""
    known = n_chars is not None and np.isfinite(float(n_chars))
    size = np.log1p(max(0.0, float(n_chars))) if known else 0.0
    return np.concatenate([_slot(lang, LANGS), _slot(source, SOURCES), [float(known), size / 10, (size / 10) ** 2]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class View:
    """A standardised logistic regression whose scores are calibrated on held-out rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, spread: np.ndarray | float = 1.0):
        self.mean, self.scale = x.mean(0), (x.std(0) + 1e-3) * spread
        self.w = logistic((x - self.mean) / self.scale, y, 1.0)
        self.fit = logistic(self.raw(held_x)[:, None], held_y, 1e-2)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -20, 20)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.fit[0] + self.fit[1]


class CoTrained:
    """Both views after the exchange, and the regression that combines their calibrated scores."""

    def __init__(self, views: list[View], text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views = views
        both = np.stack([views[0].logit(text), views[1].logit(meta)], axis=1)
        self.w = logistic(both, y, 1e-1)
        # a calibrated view never speaks against what it says: one that would gets no weight
        if (self.w[:2] < 0).any():
            use = int(self.w[1] > self.w[0])
            both[:, 1 - use] = 0
            self.w = logistic(both, y, 1e-1)
            if self.w[use] < 0:
                self.w = np.array([0.5, 0.5, 0.0])

    def __call__(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views[0].logit(text), self.views[1].logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.w[0] + b * self.w[1] + self.w[2])


def _inputs(docs: DataFrame, *more) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), *more)


def _features(part: pd.DataFrame, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' features of either view."""
    text = np.array([text_features(x if isinstance(x, str) else None, known) for x in part["text"]])
    return text, np.array([meta_features(*x) for x in zip(part["lang"], part["source"], part["n_chars"], strict=True)])


def _of(rows: DataFrame, keys: str) -> pd.DataFrame:
    """``rows``, few by what selects them, on the driver with the features of both views."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for part in parts:
            if len(part):
                text, meta = _features(part, known)
                names = [k.split()[0] for k in keys.split(", ")]
                yield part[names].assign(f_text=[x.astype(np.float32).tobytes() for x in text], f_meta=[x.astype(np.float32).tobytes() for x in meta])

    return rows.mapInPandas(run, f"{keys}, f_text binary, f_meta binary").toPandas()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1).astype(np.float64)


def _one_row_an_id(docs: DataFrame, chosen: DataFrame, names: list[str]) -> DataFrame:
    """One row of each chosen doc_id, the first by hash of its text; ``chosen`` is bounded by the caller's limits."""
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").withColumn("_h", F.xxhash64("text"))
    first = rows.groupBy("doc_id", *names).agg(F.min(F.struct("_h", "text", "lang", "source", "n_chars")).alias("_r"))
    return first.select("doc_id", *names, "_r.text", "_r.lang", "_r.source", "_r.n_chars")


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> pd.DataFrame:
    """Features and labels of the bounded sample, one row a doc_id, in the order of a hash of it."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    chosen = cut(ids.orderBy("order", "doc_id").limit(most).coalesce(1), "chosen")
    rows = _one_row_an_id(docs, chosen, ["order", "quality"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    return _of(rows, "order long, doc_id string, quality int").sort_values(["order", "doc_id"], kind="stable")


def _confident(docs: DataFrame, views: list[View], taken: tuple[set, set], most: int) -> list[tuple[int, int, str]]:
    """(view, label, doc_id): of all rows with an id, those that each view is surest of, ``most`` of a class.

    ``taken`` has the ids that are labelled in the sample or that the other view has had from this one. A task passes
    on ``most`` of a view and class at most; ties go by hash of the id, then id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        best: dict[tuple[int, int], list] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
        for part in parts:
            if not len(part):
                continue
            for v, x in enumerate(_features(part, known)):
                p = _sigmoid(views[v].logit(x))
                for c, sure in ((1, p), (0, 1 - p)):
                    at = [i for i in np.flatnonzero(sure >= CONFIDENT) if part["doc_id"].iat[i] not in taken[v]]
                    rows = {(-float(sure[i]), int(part["order"].iat[i]), part["doc_id"].iat[i]) for i in at}
                    best[v, c] = heapq.nsmallest(most, {*best[v, c], *rows})
        out = [(v, c, s, o, i) for (v, c), rows in best.items() for s, o, i in rows]
        yield pd.DataFrame(out, columns=["view", "label", "unsure", "order", "doc_id"])

    rows = _inputs(docs, F.xxhash64("doc_id").alias("order")).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("string"))
    found = cut(rows.mapInPandas(run, "view int, label int, unsure double, order long, doc_id string"), "confident")
    out = []
    for v in (0, 1):
        for c in (1, 0):
            one = found.where((F.col("view") == v) & (F.col("label") == c)).groupBy("doc_id", "order").agg(F.min("unsure").alias("unsure"))
            out += [(v, c, r.doc_id) for r in one.orderBy("unsure", "order", "doc_id").limit(most).collect()]
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained | None:
    """The classifier; None if the sample lacks eight labelled rows of either class.

    In each round either view, fitted on two quarters of the sample and what the other taught it, scores all documents
    and gives the other the ones it is surest of. A third quarter calibrates a view, the last one combines them."""
    ship(docs.sparkSession)
    found = _labelled(docs, labels, labelled)
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    if min(len(good), len(bad)) < 8:
        return None
    # folds deal out either class in turn
    rows = pd.concat([good.assign(turn=range(len(good))), bad.assign(turn=range(len(bad)))]).sort_values(["turn", "quality"], kind="stable")
    fold, y = (rows["turn"] % 4).to_numpy(), rows["quality"].to_numpy(float)
    x = (_matrix(rows["f_text"]), _matrix(rows["f_meta"]))
    start, held, last = fold < 2, fold == 2, fold == 3
    taken: tuple[set, set] = (set(found["doc_id"]), set(found["doc_id"]))
    taught: list[list[tuple[np.ndarray, int]]] = [[], []]
    for turn in range(rounds + 1):
        views = []
        for v in (0, 1):
            xs = np.vstack([x[v][start], *[f for f, _ in taught[v]]])
            views.append(View(xs, np.concatenate([y[start], [c for _, c in taught[v]]]), x[v][held], y[held], spreads(len(y))[v]))
        if turn == rounds:
            break
        told = _confident(docs, views, taken, given)
        if not told:
            continue
        ids = docs.sparkSession.createDataFrame(sorted({i for _, _, i in told}), "string").toDF("doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType))
        some = _of(_one_row_an_id(docs, ids, []).withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id string").set_index("doc_id")
        for v, c, i in told:
            taken[v].add(i)
            taught[1 - v].append((_matrix(some.loc[[i], "f_meta" if v == 0 else "f_text"]), c))
    return CoTrained(views, x[0][last], x[1][last], y[last])


def _scores(model: CoTrained | None):
    @F.pandas_udf("struct<p_text:double,p_meta:double,score:double>")
    def scored(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        if model is None or not len(text):
            return pd.DataFrame({"p_text": np.ones(len(text)), "p_meta": np.ones(len(text)), "score": np.ones(len(text))})
        t, m = _features(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n}), {})
        a, b, both = model(t, m)
        return pd.DataFrame({"p_text": a, "p_meta": b, "score": both})

    return scored("text", "lang", "source", F.col("n_chars").cast("double"))


def score(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) to doc_id, p_text, p_meta, score and keep (score >= ``least``).

    ``labels`` (doc_id, quality 0 or 1) are fitted on a bounded sample of at most ``labelled`` rows; of differing labels
    of a document the lower counts, others are ignored. All documents take part in the exchange, ``given`` of each
    class a round at most go to a view, ties by hash of doc_id. Every row is scored on its whole text, of any length,
    once each. Null texts are empty, null metadata unknown; without enough labels all scores are 1. Other columns are
    ignored; an empty table gives no rows. Options are those of fit()."""
    rows = docs.select("doc_id", _scores(fit(docs, labels, **options)).alias("s"))
    rounded = [F.round(f"s.{c}", 6).alias(c) for c in ("p_text", "p_meta", "score")]
    return rows.select("doc_id", *rounded).withColumn("keep", F.col("score") >= least)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents, with their columns, whose score is ``least`` or more."""
    return docs.where(_scores(fit(docs, labels, **options))["score"] >= least)
