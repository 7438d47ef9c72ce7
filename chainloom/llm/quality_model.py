"""Quality classifier: random-indexing word vectors pooled by document, a two-layer
network in numpy, and probabilities calibrated by a temperature.

1. Every token has a fixed sparse index vector (a few +1/-1, from its hash). The
   vector of a token is the sum of the index vectors within ``WINDOW`` tokens of it,
   over all texts. Tokens fall into ``BINS`` hash bins, so the model has a fixed
   size: each task sums its own texts and sends at most ``BINS`` rows of ``DIMS``
   whole numbers, and sums don't depend on the order of tasks.
2. A document is pooled to the mean, the mean square and the mean product of
   neighbouring vectors, and the logarithm of its token count.
3. The network is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen
   by hash); a part of it that the network doesn't see sets the temperature.

Defined results: a null or empty text has the pooled vector zero and gets the
network's score of it; a null id isn't held out; labels of unknown documents and
null labels are ignored; repeated rows are scored each; with no label, or labels of
one kind, scores are that kind's share (0.5 without labels); an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import _arrow_schema, map_rows, text_or_empty, written

BINS, DIMS, MARKS, WINDOW = 1 << 14, 32, 4, 2
TRAIN_ROWS, HIDDEN, EPOCHS, BATCH, RATE = 20_000, 32, 60, 256, 3e-3
THRESHOLD = 0.7
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall


def bin_of(token: str) -> int:
    """Words fall together without their case; words in capitals have bins of their own."""
    upper = len(token) > 1 and token.isupper()
    return zlib.crc32(("^" if upper else "").encode() + token.lower().encode()) % BINS


class Bins(dict):
    MEMORY = 1_000_000

    def __missing__(self, token: str) -> int:
        if len(self) > self.MEMORY:
            self.clear()
        found = self[token] = bin_of(token)
        return found


_bins = Bins()


def index_vectors(seed: int = 17) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = np.zeros((BINS, DIMS), np.int8)
    for k in range(MARKS):
        found[np.arange(BINS), rng.integers(0, DIMS, BINS)] += (2 * rng.integers(0, 2, BINS) - 1).astype(np.int8)
    return found


def token_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all tokens one after another, and how many each text has."""
    get, sizes, flat = _bins.__getitem__, [], []
    for t in texts:
        found = TOKENS(t)
        sizes.append(len(found))
        flat.extend(map(get, found))
    return np.array(flat, np.int32), np.array(sizes, np.int64)


def _pieces(texts: list[str], most: int = 1 << 22):
    """Runs of texts of about ``most`` characters, so that a batch takes bounded memory."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def add_contexts(texts: list[str], index: np.ndarray, sums: np.ndarray) -> None:
    """``index`` and ``sums`` have a last row for the gaps between texts, of zeros in ``index``."""
    ids, sizes = token_bins(texts)
    if not len(ids):
        return
    places = np.arange(len(ids)) + WINDOW * np.repeat(np.arange(len(sizes)), sizes)
    spread = np.full(len(ids) + WINDOW * len(sizes), BINS, np.int32)
    spread[places] = ids
    marks = index[spread]
    around = np.zeros(marks.shape, np.int8)  # at most 2 * WINDOW * MARKS
    for k in range(1, WINDOW + 1):
        around[k:] += marks[:-k]
        around[:-k] += marks[k:]
    order = np.argsort(spread.astype(np.uint16), kind="stable")  # a radix sort
    sorted_ids = spread[order]
    first = np.flatnonzero(np.r_[True, np.diff(sorted_ids) > 0])
    sums[sorted_ids[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """(BINS, DIMS) unit vectors from all texts (the one column of ``texts``)."""
    names = [f"v{k}" for k in range(DIMS)]
    schema = "bin int, " + ", ".join(f"{n} long" for n in names)
    out = _arrow_schema(texts.sparkSession, schema)

    def run(batches):
        index, sums = np.r_[index_vectors(), np.zeros((1, DIMS), np.int8)], np.zeros((BINS + 1, DIMS), np.int64)
        for batch in batches:
            for part in _pieces(batch.column(0).to_pylist()):
                add_contexts(part, index, sums)
        used = np.flatnonzero(sums[:BINS].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(sums[used, k]) for k in range(DIMS)], schema=out)

    rows = texts.mapInArrow(run, schema).groupBy("bin").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most BINS rows
    found = np.zeros((BINS, DIMS), np.float32)
    v = rows[names].to_numpy(np.float64)
    found[rows["bin"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return found


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    ids, sizes = token_bins(texts)
    found = np.zeros((len(texts), 3 * DIMS + 1), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        x, n = vectors[ids], sizes[full][:, None]
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        pairs = np.zeros_like(x)
        pairs[:-1] = x[:-1] * x[1:]
        pairs[np.cumsum(sizes[full]) - 1] = 0  # the last of a text has no neighbour in it
        for k, values in enumerate((x, x * x, pairs)):
            found[full, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(values, starts, axis=0) / n
        found[:, -1] = np.log1p(sizes) / 10
    return found


class Network:
    """Two layers, fitted by Adam on the logistic loss; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        self.temperature = 1.0
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        order = rng.permutation(len(x))
        aside, fit = order[: len(x) // 5], order[len(x) // 5 :]
        m, v, step = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        z = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for at in range(0, len(fit), BATCH):
                step += 1
                for i, g in enumerate(self._gradient(z[fit[at : at + BATCH]], y[fit[at : at + BATCH]])):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.p[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(aside):
            logits, t = self._logits(z[aside]), y[aside]
            loss = lambda T: np.logaddexp(0, logits / T * (1 - 2 * t)).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logits(self, z):
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def _gradient(self, z, y):
        h = np.tanh(z @ self.p[0] + self.p[1])
        e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y) / len(y)
        back = np.outer(e, self.p[2]) * (1 - h * h)
        decay = 1e-4
        return z.T @ back + decay * self.p[0], back.sum(axis=0), h.T @ e + decay * self.p[2], e.sum(keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -50, 50)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col))
    vectors = spark.sparkContext.broadcast(word_vectors(texts))  # BINS x DIMS numbers

    def make(columns):
        found = np.concatenate([np.zeros((0, 3 * DIMS + 1), np.float32)] + [pooled(p, vectors.value) for p in _pieces(columns[1])])
        return {"doc_id": columns[0], "x": [r.tobytes() for r in found]}

    return map_rows(docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)), make, "doc_id long, x binary")


def fit(rows: DataFrame, labels: DataFrame, label_col: str, train_rows: int = TRAIN_ROWS):
    """``rows``: doc_id, x. Learns from about ``train_rows`` labelled ids that aren't held out, chosen by a
    hash; of several rows of an id from the one whose vector comes first."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, train_rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = sorted((r.doc_id, r.y, bytes(r.x)) for r in rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect())
    y = np.array([r[1] for r in sample])
    if len(set(y)) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    return Network(np.array([np.frombuffer(r[2], np.float32) for r in sample], np.float64), y)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = written(features(docs, id_col, text_col), "pooled")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label_col))

    def make(columns):
        x = np.frombuffer(b"".join(columns[1]), np.float32).reshape(-1, 3 * DIMS + 1)
        return {"doc_id": columns[0], "score": model.value.scores(x.astype(np.float64)).tolist()}

    return map_rows(rows, make, "doc_id long, score double")


def op4_quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, labels)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
