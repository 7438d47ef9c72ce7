"""Contraction that can't leave the range of doubles, and bringing a chain back into it.

The environment of a row is kept as a mantissa and a power of two (``scaled_amplitudes``), so chains of any length give the
logarithms of their outputs. ``output_range`` is one aggregate over all series; ``in_range`` rescales a chain
once by what it says, spread over all its tensors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.fitted import FittedEncoding, resolved
from chainloom.operators.mps import Chain
from chainloom.operators.prediction import as_states, states

# Outputs above the first or below the second are brought to the third or back to the second.
LARGEST, SMALLEST, LARGE = 1e5, 1e-5, 1e4


def scaled_amplitudes(chain: Chain, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mantissas (rows, classes), exponents (rows,)): the contraction is mantissa * 2**exponent."""
    env, exponent = np.ones((len(phi), 1, 1), complex), np.zeros(len(phi), np.int64)
    for j, t in enumerate(chain.tensors):
        p = phi[:, j].conj()
        env = np.einsum("ncl,ns,lsrk->nkr", env, p, t, optimize=True) if j == chain.centre else np.einsum("ncl,ns,lsr->ncr", env, p, t, optimize=True)
        e = np.frexp(np.abs(env).max(axis=(1, 2)))[1].astype(np.int64)
        env = env * np.ldexp(1.0, -e)[:, None, None]
        exponent += e
    return env[:, :, 0], exponent


def log_scores(series: DataFrame, chain: Chain, encoding: str | FittedEncoding | None = None, d: int | None = None) -> DataFrame:
    """(series_id, label, log_weight ARRAY<DOUBLE>): logarithms of the squared amplitudes, -Infinity where one is 0."""
    e = resolved(encoding or chain.encoding, d)
    if e.by_class:
        raise ValueError("lists by class are scored by prediction.scores")
    model = series.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, exponent = scaled_amplitudes(model.value, as_states(b.column(2), b.column(3), model.value.length, e.d))
            with np.errstate(divide="ignore"):
                logs = 2 * (np.log(np.abs(m)) + exponent[:, None] * math.log(2))
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, logs.shape[1], dtype=np.int32)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["series_id", "label", "log_weight"])

    kept = series.select("series_id", F.col("label").cast("int").alias("label"), "x")
    return states(kept, e, None, "series_id", "label").mapInArrow(run, "series_id long, label int, log_weight array<double>")


def output_range(scored: DataFrame) -> DataFrame:
    """(least, greatest, n, n_zero): logarithms of the least and greatest norm of the outputs of a series that isn't 0."""
    top = F.array_max("log_weight")
    norm = (top + F.log(F.aggregate(F.transform("log_weight", lambda w: F.exp(w - top)), F.lit(0.0), lambda a, v: a + v))) / 2
    norm = F.when(top > float("-inf"), norm)
    return scored.agg(F.min(norm).alias("least"), F.max(norm).alias("greatest"), F.count("*").alias("n"), F.count_if(top == float("-inf")).alias("n_zero"))


def divided(chain: Chain, log_factor: float) -> Chain:
    """The chain with outputs divided by exp(log_factor); every tensor takes its share, since the factor may be out of range."""
    share = math.exp(-log_factor / chain.length)
    return replace(chain, tensors=tuple(t * share for t in chain.tensors))


def in_range(series: DataFrame, chain: Chain, encoding: str | FittedEncoding | None = None, d: int | None = None) -> Chain:
    """The chain, rescaled once where its greatest output is too large or else its least one too small."""
    found = output_range(log_scores(series, chain, encoding, d)).first()
    if found.greatest is None:
        return chain
    if found.greatest > math.log(LARGEST):
        return divided(chain, found.greatest - math.log(LARGE))
    if found.least < math.log(SMALLEST):
        return divided(chain, found.least - math.log(SMALLEST))
    return chain


def log_predictions(scored: DataFrame) -> DataFrame:
    """Adds ``predicted``: the class of greatest weight, the first of equal ones."""
    return scored.withColumn("predicted", (F.array_position("log_weight", F.array_max("log_weight")) - 1).cast("int"))
