"""Bootstrap of any estimator over the draws of a series at a site.

A resample is a weight for each draw: how often it is picked, by hashes of (seed, resample, pick). An
estimator gets the draws of one site (n,) and the weights of all resamples (resamples, n), and returns one
number for each resample; nothing is shuffled, and no frame is made for a site.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Estimator = Callable[[np.ndarray, np.ndarray], np.ndarray]


def hashed_uniform(seed: int, *keys: np.ndarray) -> np.ndarray:
    """In [0, 1), from a hash of whole numbers (the steps of splitmix64 for each key)."""
    h = np.uint64(seed & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for k in keys:
            h = h ^ (np.asarray(k).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def resample_weights(n: int, resamples: int, seed: int) -> np.ndarray:
    """(resamples, n): how often each of n draws is picked in n picks with replacement."""
    r, k = np.arange(resamples)[:, None], np.arange(n)[None]
    picked = np.minimum((hashed_uniform(seed, r, k) * n).astype(np.int64), n - 1)
    counts = np.bincount((picked + r * n).ravel(), minlength=resamples * n)
    return counts.reshape(resamples, n).astype(float)


def mean(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights @ x / weights.sum(axis=1)


def histogram_mode(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The middle of the fullest of ceil(sqrt(n)) equal bins of each resample's own range, the lowest of equal ones."""
    n_bins = int(np.ceil(np.sqrt(len(x))))
    held = weights > 0
    low, high = np.where(held, x, np.inf).min(axis=1), np.where(held, x, -np.inf).max(axis=1)
    width = np.where(high > low, (high - low) / n_bins, 1.0)
    bins = np.clip(((x - low[:, None]) / width[:, None]).astype(np.int64), 0, n_bins - 1)
    counts = np.bincount((bins + n_bins * np.arange(len(weights))[:, None]).ravel(), weights.ravel(), len(weights) * n_bins).reshape(-1, n_bins)
    return np.where(high > low, low + (counts.argmax(axis=1) + 0.5) * width, low)


def density_mode(x: np.ndarray, weights: np.ndarray, points: int = 101, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Where a Gaussian density estimate is greatest on a grid of the range; one bandwidth by Silverman's rule, of the draws themselves."""
    grid, n = np.linspace(low, high, points), len(x)
    spread = min(x.std(), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34 or x.std())
    width = max(0.9 * spread * n**-0.2, 1e-3)
    bumps = np.exp(-0.5 * ((grid[None] - x[:, None]) / width) ** 2)
    return grid[(weights @ bumps).argmax(axis=1)]


ESTIMATORS: dict[str, Estimator] = {"mean": mean, "histogram_mode": histogram_mode, "density_mode": density_mode}


def bootstrapped(draws: DataFrame, estimator: str | Estimator = "density_mode", resamples: int = 200, seed: int = 0) -> DataFrame:
    """(series_id, t, estimate, error, ci): mean and deviation of an estimator over the resamples, and
    2.576 * error / sqrt(resamples). ``draws``: series_id, t, xs (the values drawn); nothing drawn gives nulls."""
    find = ESTIMATORS[estimator] if isinstance(estimator, str) else estimator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[int, np.ndarray] = {}  # by number of draws, of which there are few
        for b in batches:
            found = []
            for xs in b.column(2):
                x = np.array(xs.values.to_numpy(zero_copy_only=False) if xs.is_valid else [], float)
                if not len(x):
                    found.append((None, None))
                    continue
                if len(x) not in weights:
                    weights[len(x)] = resample_weights(len(x), resamples, seed)
                made = find(x, weights[len(x)])
                found.append((float(made.mean()), float(made.std(ddof=1)) if resamples > 1 else 0.0))
            estimate, error = (pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))
            ci = pa.array([None if e is None else 2.576 * e / np.sqrt(resamples) for _, e in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), estimate, error, ci], names=["series_id", "t", "estimate", "error", "ci"])

    rows = draws.select(F.col("series_id").cast("long"), F.col("t").cast("int"), "xs")
    return rows.mapInArrow(run, "series_id long, t int, estimate double, error double, ci double")
