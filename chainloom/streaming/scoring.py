"""Scores and errors over streams of series.

The reference work has no streams; these carry its scoring and its forecast errors over to
Structured Streaming, with the model broadcast and state bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.fitted import FittedEncoding
from chainloom.operators.mps import Chain
from chainloom.operators.prediction import predictions, scores


def scored_stream(series: DataFrame, chain: Chain, encoding: str | FittedEncoding | None = None, d: int | None = None) -> DataFrame:
    """A stream of (series_id, label, weight, predicted); stateless."""
    return predictions(scores(series, chain, encoding, d))


def windowed_series(events: DataFrame, ts: str, key: str, value: str, window: str = "1 day", slots: int = 24, late: str = "2 hours") -> DataFrame:
    """A stream of (key, start, means): the means of a window's equal slots, once the watermark has passed it."""
    w = F.window(ts, window)
    width = (F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("w.start"))) / slots
    at = F.floor((F.unix_micros(F.col(ts)) - F.unix_micros(F.col("w.start"))) / width).cast("int")
    placed = events.withWatermark(ts, late).withColumn("w", w).withColumn("slot", at)
    means = [F.avg(F.when(F.col("slot") == k, F.col(value))).alias(f"m{k}") for k in range(slots)]
    grouped = placed.groupBy(F.col(key), F.window(ts, window).alias("win")).agg(*means)
    return grouped.select(key, F.col("win.start").alias("start"), F.array(*[f"m{k}" for k in range(slots)]).alias("means"))


def running_errors(pairs: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Forecast errors by tumbling window of a stream with ``actual`` and ``forecast``."""
    a, f = F.col("actual"), F.col("forecast")
    grouped = pairs.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("win"))
    return grouped.agg(F.avg(F.abs(a - f)).alias("mae"), F.avg((a - f) * (a - f)).alias("mse"), F.count("*").alias("n")).select(key, F.col("win.start").alias("start"), "mae", "mse", "n")
