"""Synthetic series. Every random number is a hash of (seed, series, place), so the same
rows come out whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_of(seed: int, *keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal_of(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2.0 * F.log(uniform_of(seed, *keys))) * F.cos(2 * math.pi * uniform_of(seed + 1_000_003, *keys))


def _series(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n).withColumnRenamed("id", "series_id")


def _over_time(length: int, value) -> Column:
    """``value`` of the place, as a column from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: value(t).cast("double"))


def _placed(series: DataFrame, length: int, value: Column) -> DataFrame:
    """Series from a value that needs random numbers for each place."""
    long = series.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t")).withColumn("v", value.cast("double"))
    return long.groupBy("series_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))


def constant_classes(spark: SparkSession, per_class: int, length: int = 5, seed: int = 0) -> DataFrame:
    """Series of zeros (label 0) and of ones (label 1), in random order."""
    rows = _series(spark, 2 * per_class).withColumn("label", (F.col("series_id") % 2).cast("int"))
    return rows.withColumn("x", F.array_repeat(F.col("label").cast("double"), length)).orderBy(uniform_of(seed, F.col("series_id")))


def sinusoids(spark: SparkSession, n: int, length: int, frequencies: tuple[float, float] = (1.0, 6.0), noise: float = 0.0, train_share: float = 0.7, seed: int = 0) -> DataFrame:
    """Two classes of sines with random phases; column ``split`` is train or test."""
    rows = _series(spark, n).withColumn("label", (F.col("series_id") % 2).cast("int"))
    phase = uniform_of(seed, F.col("series_id")) * 2 * math.pi
    frequency = F.when(F.col("label") == 0, frequencies[0]).otherwise(frequencies[1])
    value = F.sin(F.col("t") * (2 * math.pi / length) * frequency + phase) + noise * normal_of(seed + 1, F.col("series_id"), F.col("t"))
    made = _placed(rows, length, value)
    return made.withColumn("split", F.when(uniform_of(seed + 2, F.col("series_id")) < train_share, "train").otherwise("test"))


def sine_or_noise(spark: SparkSession, n: int, length: int, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """Sines with noise (label 0) against Gaussian noise (label 1), split 70/15/15."""
    rows = _series(spark, n).withColumn("label", (F.col("series_id") % 2).cast("int"))
    phase, g = uniform_of(seed, F.col("series_id")) * 2 * math.pi, normal_of(seed + 1, F.col("series_id"), F.col("t"))
    value = F.when(F.col("label") == 0, F.sin(F.col("t") * (2 * math.pi / length) + phase) + noise * g).otherwise(g)
    u = uniform_of(seed + 2, F.col("series_id"))
    return _placed(rows, length, value).withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "validation").otherwise("test"))


#: Amplitude, turns, slope and noise of the two classes.
TRENDS = ((1.0, 2.0, 0.01, 0.1), (1.0, 4.0, -0.01, 0.1))


def trended(spark: SparkSession, n: int, length: int = 100, parameters=TRENDS, seed: int = 0) -> DataFrame:
    """Amplitude times a sine, plus a slope, plus uniform noise; one parameter set (amplitude, turns,
    slope, noise) for each class. The turns end at the last point, the slope counts from 1."""
    rows = _series(spark, n).withColumn("label", (F.col("series_id") % len(parameters)).cast("int"))
    sets = F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for ps in parameters])
    a, f, slope, sigma = (sets[F.col("label")][i] for i in range(4))
    phase = uniform_of(seed, F.col("series_id")) * 2 * math.pi
    value = a * F.sin(F.col("t") * (2 * math.pi / max(length - 1, 1)) * f + phase) + slope * (F.col("t") + 1) + sigma * uniform_of(seed + 1, F.col("series_id"), F.col("t"))
    return _placed(rows, length, value)


def box_labels(values: DataFrame, n_bins: int = 20, domain: tuple[float, float] = (0.0, 1.0), seed: int = 0) -> DataFrame:
    """Labels the values ``v`` 1 in a random half of equal bins of the domain, else 0."""
    low, high = domain
    b = F.least(F.floor((F.col("v") - low) / ((high - low) / n_bins)), F.lit(n_bins - 1))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda k: F.struct(uniform_of(seed, k).alias("u"), k.alias("k"))))
    chosen = F.transform(F.slice(order, 1, n_bins // 2), lambda s: s["k"])
    return values.withColumn("label", F.array_contains(chosen, b.cast("int")).cast("int"))


def truncated_pairs(spark: SparkSession, per_class: int, seed: int = 0, tries: int = 64) -> DataFrame:
    """Two classes of Gaussian points, each the first of ``tries`` draws inside the unit square; a row
    without one (less than one in 10**80) has its first draw moved to the square's edge."""
    rows = _series(spark, 2 * per_class).withColumn("label", (F.col("series_id") % 2).cast("int"))
    centre = F.when(F.col("label") == 0, 0.3).otherwise(0.7)
    draw = lambda k, j: centre + 0.15 * normal_of(seed + k, F.col("series_id"), j)
    draws = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda j: F.array(draw(0, j), draw(7, j)))
    inside = F.filter(draws, lambda p: F.forall(p, lambda v: v.between(0.0, 1.0)))
    edge = F.transform(draws[0], lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("x", F.coalesce(F.get(inside, F.lit(0)), edge))
