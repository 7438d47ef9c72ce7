"""Scaling and discretisation of series, as column expressions with fitted parameters.

Series are rows ``(series_id, label, x ARRAY<DOUBLE>)``. Fits are aggregates whose
results are a few numbers (or one row for each time point); transforms are narrow.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.quantiles import exact_quantiles


def sigmoid(v: Column, signed: bool = False) -> Column:
    p = 1.0 / (1.0 + F.exp(-v))
    return 2.0 * p - 1.0 if signed else p


@dataclass(frozen=True)
class RobustSigmoid:
    """1 / (1 + exp(-(v - median) / (iqr / k))), fitted on all cells of the training series."""

    median: float
    iqr: float
    k: float = 1.35

    @staticmethod
    def fit(series: DataFrame, k: float = 1.35) -> RobustSigmoid:
        cells = series.select(F.explode("x").alias("v"))
        low, mid, high = exact_quantiles(cells, F.col("v"), [0.25, 0.5, 0.75])
        return RobustSigmoid(mid, high - low, k)

    def value(self, v: Column, signed: bool = False) -> Column:
        if self.iqr == 0:  # constant series: all values are the median
            return F.lit(0.0 if signed else 0.5)
        return sigmoid((v - F.lit(self.median)) / F.lit(self.iqr / self.k), signed)

    def transform(self, series: DataFrame, signed: bool = False) -> DataFrame:
        return series.withColumn("x", F.transform("x", lambda v: self.value(v, signed)))


@dataclass(frozen=True)
class MinMax:
    """Affine map of [low, high] to the range of an encoding."""

    low: float
    high: float

    @staticmethod
    def fit(series: DataFrame) -> MinMax:
        return MinMax(*series.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first())

    def transform(self, series: DataFrame, to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
        a, b = to
        if self.high == self.low:
            return series.withColumn("x", F.transform("x", lambda v: F.lit(float(a))))
        return series.withColumn("x", F.transform("x", lambda v: F.lit(float(a)) + F.lit(float(b - a)) * ((v - F.lit(self.low)) / F.lit(self.high - self.low))))


def scaled(train: DataFrame, *others: DataFrame, to: tuple[float, float] = (0.0, 1.0), minmax_fit: str = "self") -> list[DataFrame]:
    """Robust sigmoid fitted on ``train``, then min-max to the range ``to``; each set uses its own
    extrema (``minmax_fit="self"``) or those of the training set (``"train"``)."""
    fit = RobustSigmoid.fit(train)
    sets = [fit.transform(s) for s in (train, *others)]
    first = MinMax.fit(sets[0])
    return [(first if minmax_fit == "train" else MinMax.fit(s)).transform(s, to) for s in sets]


def standard_fit(series: DataFrame, sample: bool = False) -> DataFrame:
    """(t, mean, deviation): one row for each time point."""
    long = series.select(F.posexplode("x").alias("t", "v"))
    return long.groupBy("t").agg(F.avg("v").alias("mean"), (F.stddev_samp if sample else F.stddev_pop)("v").alias("deviation"))


def standard_transform(series: DataFrame, fit: DataFrame) -> DataFrame:
    """(series_id, label, t, v) scaled by time point; a deviation of 0 gives 0."""
    long = series.select("series_id", "label", F.posexplode("x").alias("t", "v"))
    z = F.when(F.col("deviation") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("v") - F.col("mean"), F.col("deviation")))
    return long.join(fit, "t").select("series_id", "label", "t", z.alias("v"))


def array_median(x: Column) -> Column:
    s = F.array_sort(x)
    n = F.size(x)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2.0


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def binarised(x: Column, method: str = "median") -> Column:
    """1 where a value reaches the series' own median or mean; for ``minimum``, 0 where it is the least."""
    if method == "minimum":
        return F.transform(x, lambda v: F.when(v == F.array_min(x), 0).otherwise(1))
    threshold = {"median": array_median, "mean": array_mean}[method](x)
    return F.transform(x, lambda v: F.when(v >= threshold, 1).otherwise(0))


def letter(bin_number: Column) -> Column:
    return F.char(F.lit(97) + bin_number)


def sax_cuts(n_bins: int) -> list[float]:
    """Cut points of equal probability under the standard normal law."""
    return [NormalDist().inv_cdf(i / n_bins) for i in range(1, n_bins)]


def cut_bin(v: Column, cuts: list[float] | Column) -> Column:
    """How many cut points a value exceeds."""
    if isinstance(cuts, list):
        return sum((F.when(v > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return F.size(F.filter(cuts, lambda c: v > c))


def uniform_bin(v: Column, low: Column, high: Column, n_bins: int) -> Column:
    width = (high - low) / n_bins
    return F.least(F.floor(F.coalesce(F.try_divide(v - low, width), F.lit(0.0))).cast("int"), F.lit(n_bins - 1))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))
