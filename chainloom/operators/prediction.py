"""Local states as arrays from Catalyst, contraction with a broadcast chain in Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.encodings import checked
from chainloom.functions.fitted import FittedEncoding, resolved
from chainloom.functions.quantiles import grouped_quantiles
from chainloom.operators.mps import Chain


def states(series: DataFrame, encoding: str | FittedEncoding, d: int | None, *kept: str) -> DataFrame:
    """``kept`` columns and ``re``, ``im``: the d components of every value, one after another. An encoding
    by class takes the lists of each series' own ``label``."""
    e = resolved(encoding, d)
    z = checked(series, e).withColumn("z", e.column(F.col("label") if e.by_class else None))
    return z.select(*kept, F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def as_states(re: pa.Array, im: pa.Array, length: int, d: int) -> np.ndarray:
    """(rows, sites, d) complex."""
    flat = re.flatten().to_numpy(zero_copy_only=False) + 1j * im.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, length, d)


def amplitudes(chain: Chain, phi: np.ndarray) -> np.ndarray:
    """(rows, classes): contraction of the conjugate states with the chain."""
    env = np.ones((len(phi), 1, 1), complex)  # row, class so far, bond
    for j, t in enumerate(chain.tensors):
        p = phi[:, j].conj()
        env = np.einsum("ncl,ns,lsrk->nkr", env, p, t, optimize=True) if j == chain.centre else np.einsum("ncl,ns,lsr->ncr", env, p, t, optimize=True)
    return env[:, :, 0]


def scores(series: DataFrame, chain: Chain, encoding: str | FittedEncoding | None = None, d: int | None = None) -> DataFrame:
    """(series_id, label, weight ARRAY<DOUBLE>): squared amplitudes of each class. Without ``encoding`` that
    of the chain is taken; one by class encodes a series once for each class, whose amplitude then counts."""
    e = resolved(encoding or chain.encoding, d)
    model, n = series.sparkSession.sparkContext.broadcast(chain), chain.n_classes
    kept = series.select("series_id", F.col("label").cast("int").alias("label"), "x")
    if e.by_class:
        z = checked(kept, e).withColumn("z", F.flatten(F.array(*[e.column(F.lit(c)) for c in range(n)])))
        rows = z.select("series_id", "label", F.col("z.re").alias("re"), F.col("z.im").alias("im"))
    else:
        rows = states(kept, e, None, "series_id", "label")

    def amplitude_of(phi: np.ndarray) -> np.ndarray:
        if not e.by_class:
            return amplitudes(model.value, phi)
        each = phi.reshape(-1, n, model.value.length, e.d)
        return np.stack([amplitudes(model.value, each[:, c])[:, c] for c in range(n)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.abs(amplitude_of(as_states(b.column(2), b.column(3), model.value.length, e.d))) ** 2
            weights = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), weights], names=["series_id", "label", "weight"])

    return rows.mapInArrow(run, "series_id long, label int, weight array<double>")


def predictions(scored: DataFrame) -> DataFrame:
    """Adds ``predicted``: the class of greatest weight, the first of equal ones; from 0."""
    return scored.withColumn("predicted", (F.array_position("weight", F.array_max("weight")) - 1).cast("int"))


def summary(scored: DataFrame) -> DataFrame:
    """One row: accuracy, mean -log weight of the true class, and mean squared error of the amplitudes' size."""
    p = predictions(scored)
    true = F.element_at("weight", F.col("label") + 1)
    target = F.transform(F.col("weight"), lambda w, c: F.pow(F.sqrt(w) - F.when(c == F.col("label"), 1.0).otherwise(0.0), 2.0))
    return p.agg(
        F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.avg(-F.log(true)).alias("kld"),
        F.avg(F.aggregate(target, F.lit(0.0), lambda a, v: a + v) / 2.0).alias("mse"), F.count("*").alias("n"),
    )


def overlap_statistics(scored: DataFrame) -> DataFrame:
    """(label, model, median, least, greatest) of the class overlaps by true class."""
    long = scored.select("label", F.posexplode("weight").alias("model", "w")).withColumn("o", F.sqrt("w"))
    medians = grouped_quantiles(long, ["label", "model"], "o", [0.5]).select(F.struct("label", "model").alias("g"), F.col("quantiles")[0].alias("median"))
    extent = long.groupBy(F.struct("label", "model").alias("g")).agg(F.min("o").alias("least"), F.max("o").alias("greatest"))
    return extent.join(medians, "g", "left").select("g.*", "median", "least", "greatest")
