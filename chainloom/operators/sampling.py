"""Sampling from class states: forecasts, interpolation, and their summaries.

One pass over the series: a row is a series, and the chain of its class is chosen in the task, where rows of
an Arrow batch are grouped by label and all class states are broadcast. Known sites condition the state
from both sides, once for a series; its shots are made there as an axis, and missing sites are drawn from left to
right (``density``). Random numbers are hashes of (seed, series, shot, site): any partitioning gives the
same trajectories.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.fitted import FittedEncoding, resolved
from chainloom.operators.bootstrap import bootstrapped
from chainloom.operators.density import samplers, states_at
from chainloom.operators.metrics import forecast_errors
from chainloom.operators.prediction import as_states, states
from chainloom.sources.generators import uniform_of

ROWS_AT_ONCE = 8192  # series times shots


def _unit(m: np.ndarray, axes) -> np.ndarray:
    return m / np.maximum(np.sqrt((np.abs(m) ** 2).sum(axis=axes, keepdims=True)), 1e-300)


def drawn(tensors: Sequence[np.ndarray], phi: np.ndarray, missing: list[int], u: np.ndarray, by_site: list, ordered: bool = False) -> np.ndarray:
    """(rows, shots, missing sites): values drawn for the sites in ``missing`` (ascending), the others fixed by
    their states ``phi`` (rows, sites, d). ``u``: (rows, shots, missing). ``ordered``: a site knows of what is to its left alone."""
    n, length, first, last = len(phi), len(tensors), missing[0], missing[-1]
    right: dict[int, np.ndarray] = {}  # (rows or 1, bond, bond): what is to the right of a missing site
    if ordered:
        env = np.ones((1, 1, 1), complex)
    else:
        v = np.ones((n, 1), complex)
        for j in range(length - 1, last, -1):
            v = _unit(np.einsum("ns,lsr,nr->nl", phi[:, j].conj(), tensors[j], v, optimize=True), 1)
        env = v[:, :, None] * v[:, None, :].conj()
    for j in range(length - 1 if ordered else last, first - 1, -1):
        if j in missing:
            right[j] = env
        if j > first:
            if ordered or j in missing:
                env = np.einsum("lsr,nrq,ksq->nlk", tensors[j], env, tensors[j].conj(), optimize=True)
            else:
                one = np.einsum("ns,lsr->nlr", phi[:, j].conj(), tensors[j], optimize=True)
                env = one @ env @ one.conj().transpose(0, 2, 1)
            env = _unit(env, (1, 2))
    left = np.ones((n, 1), complex)
    for j in range(first):
        left = _unit(np.einsum("ns,nl,lsr->nr", phi[:, j].conj(), left, tensors[j], optimize=True), 1)
    left, out = left[:, None], np.zeros(u.shape)  # row, shot or 1, bond
    for j in range(first, last + 1):
        m = np.einsum("nxl,lsr->nxsr", left, tensors[j], optimize=True)
        if j in missing:
            k = missing.index(j)
            rho = m @ right[j][:, None] @ m.conj().swapaxes(2, 3)
            rho = np.broadcast_to(rho, (n, u.shape[1], *rho.shape[2:])).reshape(-1, *rho.shape[2:])
            x, here = by_site[j % len(by_site)].draw(rho, u[:, :, k].ravel())
            out[:, :, k], here = x.reshape(n, -1), here.reshape(n, u.shape[1], -1)
        else:
            here = phi[:, None, j]
        left = _unit((here.conj()[:, :, None] @ m)[:, :, 0], 2)
    return out


def draws(series: DataFrame, class_states: Sequence, encoding: str | FittedEncoding, d: int | None, missing: list[int], shots: int, seed: int = 0, points: int = 200, ordered: bool = False, method: str = "grid") -> DataFrame:
    """(series_id, label, t, xs ARRAY<DOUBLE>): for every series and site in ``missing`` the values of all shots.

    ``class_states``: the tensors of each class, by label, or those of one state for all series. Other sites
    condition the missing ones, also those that come later, unless ``ordered``: then sites are met in the order
    of time and only earlier ones count. The last sites as ``missing`` make it a forecast. ``method``: see ``density.samplers``.
    """
    spark, e, missing = series.sparkSession, resolved(encoding, d), sorted(set(missing))
    alone = isinstance(class_states[0], np.ndarray)
    tensors = [list(class_states)] if alone else [list(t) for t in class_states]
    by_class = [samplers(spark, e, method, points, c) for c in range(len(tensors))] if e.by_class else [samplers(spark, e, method, points)] * len(tensors)
    model, length = spark.sparkContext.broadcast((tensors, by_class)), len(tensors[0])
    schema = "series_id long, label int, t int, xs array<double>"
    if not missing or shots < 1:
        return spark.createDataFrame([], schema)
    gone = F.array(*[F.lit(t) for t in missing])
    hidden = series.select("series_id", F.col("label").cast("int").alias("label"), F.transform("x", lambda v, t: F.when(F.array_contains(gone, t), F.lit(float(e.low))).otherwise(v)).alias("x"))
    u = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shots - 1)), lambda s: F.array(*[uniform_of(seed, F.col("series_id"), s, F.lit(t)) for t in missing])))
    rows = states(hidden, e, None, "series_id", "label").select("series_id", "label", "re", "im", u.alias("u"))
    k, most = len(missing), max(1, ROWS_AT_ONCE // shots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tensors, by_class = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                label = np.zeros(b.num_rows, int) if alone else b.column(1).to_numpy(zero_copy_only=False)
                phi = as_states(b.column(2), b.column(3), length, e.d)
                u = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, shots, k)
                x = np.zeros((b.num_rows, k, shots))
                for c in np.unique(label):
                    if not 0 <= c < len(tensors):  # NaN, where there is a null, isn't either
                        raise ValueError(f"a series has the label {c}, of which there is no state")
                    own = np.flatnonzero(label == c)
                    x[own] = drawn(tensors[int(c)], phi[own], missing, u[own], by_class[int(c)], ordered).transpose(0, 2, 1)
                xs = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, shots, dtype=np.int32)), pa.array(x.ravel()))
                ids, labels = (pa.array(np.repeat(np.arange(b.num_rows), k)) for _ in range(2))
                yield pa.RecordBatch.from_arrays([b.column(0).take(ids), b.column(1).take(labels), pa.array(np.tile(np.array(missing, np.int32), b.num_rows)), xs], names=["series_id", "label", "t", "xs"])

    return rows.mapInArrow(run, schema)


def each_shot(found: DataFrame) -> DataFrame:
    """(series_id, shot, t, x) of ``draws``."""
    return found.select("series_id", "t", F.posexplode("xs").alias("shot", "x")).select("series_id", "shot", "t", "x")


def imputed(series: DataFrame, class_states: Sequence, encoding: str | FittedEncoding, d: int | None, missing: list[int], shots: int, seed: int = 0, points: int = 200, ordered: bool = False, method: str = "grid") -> DataFrame:
    """(series_id, shot, t, x): ``draws``, a row for each shot."""
    return each_shot(draws(series, class_states, encoding, d, missing, shots, seed, points, ordered, method))


def last_sites(class_states: Sequence, horizon: int) -> list[int]:
    length = len(class_states if isinstance(class_states[0], np.ndarray) else class_states[0])
    return list(range(length - horizon, length))


def forecast(series: DataFrame, class_states: Sequence, encoding: str | FittedEncoding, d: int | None, horizon: int, shots: int, seed: int = 0, method: str = "grid") -> DataFrame:
    return imputed(series, class_states, encoding, d, last_sites(class_states, horizon), shots, seed, method=method)


def sampled(spark: SparkSession, tensors: Sequence[np.ndarray], encoding: str | FittedEncoding, d: int | None, n: int, seed: int = 0, method: str = "grid") -> DataFrame:
    """(series_id, shot, t, x): ``n`` whole series drawn from a state, which nothing conditions."""
    e = resolved(encoding, d)
    blank = spark.range(n).select(F.col("id").alias("series_id"), F.lit(0).alias("label"), F.array_repeat(F.lit(float(e.low)), len(tensors)).alias("x"))
    return imputed(blank, tensors, e, None, list(range(len(tensors))), 1, seed, method=method)


def truth_of(series: DataFrame, sites: list[int]) -> DataFrame:
    """(series_id, t, actual) of some sites."""
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.get("x", F.lit(t)).alias("actual")) for t in sites]))
    return series.select("series_id", wanted.alias("s")).select("series_id", "s.t", "s.actual")


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)


def trajectory(found: DataFrame) -> DataFrame:
    """(series_id, label, t, mean, deviation, n) of ``draws``, without a shuffle."""
    n, mean = F.size("xs"), F.col("mean")
    square = F.aggregate("xs", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    found = found.withColumn("mean", _mean(F.col("xs")))
    return found.select("series_id", "label", "t", mean, F.sqrt(F.try_divide(square, n - 1.0)).alias("deviation"), n.cast("long").alias("n"))


def class_forecast_scores(series: DataFrame, class_states: Sequence, encoding: str | FittedEncoding, d: int | None, horizon: int, shots: int, seed: int = 0) -> DataFrame:
    """(label, n_series, mape, smape, mse, mae, rmse): every series forecast by the state of its class,
    errors of the mean trajectory over all series and steps of a class."""
    sites = last_sites(class_states, horizon)
    pairs = trajectory(draws(series, class_states, encoding, d, sites, shots, seed)).join(truth_of(series, sites), ["series_id", "t"])
    errors = forecast_errors(pairs, ["label"], "actual", "mean")
    return series.groupBy("label").agg(F.count("*").alias("n_series")).join(errors, "label")


def forecast_sweep(series: DataFrame, class_states: Sequence, encoding: str | FittedEncoding, d: int | None, horizons: list[int], shots: list[int], seed: int = 0) -> DataFrame:
    """(horizon, shots, smape, ...): errors of the mean trajectory for each horizon and number of shots. The
    shots of a horizon are drawn once; a smaller number takes the first of them."""
    found = []
    for horizon in horizons:
        sites = last_sites(class_states, horizon)
        drawn_once = draws(series, class_states, encoding, d, sites, max(shots), seed)
        means = F.explode(F.array(*[F.struct(F.lit(n).alias("shots"), _mean(F.slice("xs", 1, n)).alias("mean")) for n in sorted(shots)]))
        pairs = drawn_once.select("series_id", "t", means.alias("s")).select("series_id", "t", "s.*").join(truth_of(series, sites), ["series_id", "t"])
        found.append(forecast_errors(pairs, ["shots"], "actual", "mean").withColumn("horizon", F.lit(horizon)))
    return reduce(lambda a, b: a.unionByName(b), found)


def trajectories(shots: DataFrame) -> DataFrame:
    """(series_id, t, mean, deviation, n) over rows of shots."""
    return shots.groupBy("series_id", "t").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"), F.count("*").alias("n"))


def bootstrapped_mode(shots: DataFrame, resamples: int = 200, seed: int = 0, estimator="density_mode") -> DataFrame:
    """(series_id, t, mode, error, ci) of rows of shots, or of ``draws``; see ``bootstrap``."""
    if "xs" not in shots.columns:
        ordered = F.array_sort(F.collect_list(F.struct("shot", "x")))  # a site's shots
        shots = shots.groupBy("series_id", "t").agg(F.transform(ordered, lambda s: s["x"]).alias("xs"))
    return bootstrapped(shots, estimator, resamples, seed).withColumnRenamed("estimate", "mode")


def encoding_bias(series: DataFrame, encoding: str | FittedEncoding, d: int | None = None, nodes: int = 64) -> DataFrame:
    """(series_id, t, x, mean): for each value the mean of the density that its encoded state alone implies, by
    Gauss-Legendre integration over the encoding's range (over each bin of a split one)."""
    spark, e = series.sparkSession, resolved(encoding, d)
    at, weight = np.polynomial.legendre.leggauss(nodes)
    lists = [[()]] if e.spec.kind in ("plain", "projected") else e.lists
    spans = [[list(zip(b, b[1:])) or [(e.low, e.high)] for b in by_time] for by_time in lists]
    y = np.array([[np.concatenate([(a + b) / 2 + (b - a) / 2 * at for a, b in s]) for s in by_time] for by_time in spans])
    w = np.array([[np.concatenate([(b - a) / 2 * weight for a, b in s]) for s in by_time] for by_time in spans])
    if e.spec.kind == "projected":
        y, w = (np.repeat(z, e.length, axis=1) for z in (y, w))
    phi = np.array([states_at(spark, e, by_time, c) for c, by_time in enumerate(y)])
    sent = spark.sparkContext.broadcast((y, w, phi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, w, nodes_phi = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                length = len(b.column(2)[0].as_py())
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                own = as_states(b.column(3), b.column(4), length, e.d)
                label = b.column(1).to_numpy(zero_copy_only=False).astype(int) if e.by_class else np.zeros(len(x), int)
                mean = np.zeros_like(x)
                for c in np.unique(label):
                    rows = np.flatnonzero(label == c)
                    for t in range(length):
                        s = t if y.shape[1] > 1 else 0
                        p = np.abs(own[rows, t] @ nodes_phi[c, s].conj().T) ** 2 * w[c, s]
                        mean[rows, t] = (p @ y[c, s]) / np.maximum(p.sum(axis=1), 1e-300)
                ids = pa.array(np.repeat(np.arange(len(x)), length))
                yield pa.RecordBatch.from_arrays([b.column(0).take(ids), pa.array(np.tile(np.arange(length, dtype=np.int32), len(x))), pa.array(x.ravel()), pa.array(mean.ravel())], names=["series_id", "t", "x", "mean"])

    z = states(series, e, None, "series_id", F.col("label").cast("int").alias("label"), "x")
    return z.mapInArrow(run, "series_id long, t int, x double, mean double")


def bias_by_bin(biases: DataFrame, low: float, high: float, n_bins: int) -> DataFrame:
    """(bin, n, bias, size): mean and mean absolute difference of ``mean`` to ``x`` in equal bins of the range."""
    b = F.least(F.floor((F.col("x") - low) * (n_bins / (high - low))), F.lit(n_bins - 1)).cast("int")
    gap = F.col("mean") - F.col("x")
    return biases.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("size"))


def grid_states(spark: SparkSession, encoding: str | FittedEncoding, d: int | None, points: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Grid values of the range and their local states, by the same expressions as for data."""
    e = resolved(encoding, d)
    grid = np.minimum(e.low + np.arange(points) * ((e.high - e.low) / (points - 1)), e.high)
    return grid, states_at(spark, e, grid[None])[0]


def marginals(spark: SparkSession, tensors: list[np.ndarray], encoding: str, d: int, points: int = 50) -> DataFrame:
    """(t, x, p): the density of each site on a grid, the other sites traced out."""
    grid, phi = grid_states(spark, encoding, d, points)
    right = [np.ones((1, 1), complex)]
    for a in reversed(tensors[1:]):
        right.append(np.einsum("lsr,rq,ksq->lk", a, right[-1], a.conj()))
    right.reverse()
    left, rows = np.ones((1, 1), complex), []
    for t, a in enumerate(tensors):
        density = np.einsum("lk,lsr,rq,kuq->su", left, a, right[t], a.conj())
        p = np.einsum("gs,su,gu->g", phi.conj(), density, phi).real
        area = ((p[1:] + p[:-1]) / 2 * np.diff(grid)).sum()
        rows += [(t, float(x), float(v / area)) for x, v in zip(grid, p)]
        left = np.einsum("lk,lsr,ksq->rq", left, a, a.conj())
        left = left / abs(np.trace(left))
    return spark.createDataFrame(rows, "t int, x double, p double")
