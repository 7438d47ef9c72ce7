"""Forecast errors, classification counts and histogram rules, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.quantiles import grouped_quantiles


def mape(a: Column, f: Column) -> Column:
    return F.avg(F.try_divide(F.abs(a - f), F.abs(a)))


def smape(a: Column, f: Column) -> Column:
    return F.avg(F.try_divide(F.abs(a - f), (F.abs(a) + F.abs(f)) / 2.0))


def mse(a: Column, f: Column) -> Column:
    return F.avg((a - f) * (a - f))


def mae(a: Column, f: Column) -> Column:
    return F.avg(F.abs(a - f))


def rmse(a: Column, f: Column) -> Column:
    return F.sqrt(mse(a, f))


def forecast_errors(pairs: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    a, f = F.col(actual), F.col(forecast)
    measures = {"mape": mape, "smape": smape, "mse": mse, "mae": mae, "rmse": rmse}
    return pairs.groupBy(*by).agg(*[m(a, f).alias(name) for name, m in measures.items()])


def naive_scale(train: DataFrame, keys: list[str], t: str, v: str, season: int = 1) -> DataFrame:
    """Mean absolute difference to the value ``season`` steps before, for each series."""
    before = F.lag(v, season).over(Window.partitionBy(*keys).orderBy(t)) if keys else F.lag(v, season).over(Window.orderBy(t))
    return train.withColumn("d", F.abs(F.col(v) - before)).groupBy(*keys).agg(F.avg("d").alias("scale"))


def confusion(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n): all pairs of classes, also those that don't occur."""
    counts = predictions.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = predictions.select(F.explode(F.array(truth, predicted)).alias("c")).distinct()
    listed = classes.agg(F.array_sort(F.collect_set("c")).alias("cs"))  # one row for the classes
    pairs = listed.select(F.explode("cs").alias("truth"), "cs").select("truth", F.explode("cs").alias("predicted"))
    return pairs.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binary_scores(predictions: DataFrame, truth: str | Column, predicted: str | Column, by: tuple = (), times: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, specificity, F1 and balanced accuracy; values other than 0 are positive.
    ``truth`` and ``predicted``: columns, or conditions; ``times``: how often a row counts."""
    t, p = (F.col(c) != 0 if isinstance(c, str) else c for c in (truth, predicted))
    each = F.col(times).cast("long") if times else F.lit(1).cast("long")
    n = predictions.groupBy(*by).agg(*[F.sum(c.cast("long") * each).cast("double").alias(k) for k, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return n.select(
        *by, F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"),
        F.try_divide(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"), ((recall + specificity) / 2.0).alias("balanced_accuracy"),
    )


def finite(values: DataFrame, v: str) -> DataFrame:
    return values.filter(F.abs(F.col(v).cast("double")) < float("inf"))  # NaN is above all numbers


def bin_rules(values: DataFrame, by: list[str], v: str) -> DataFrame:
    """Numbers of histogram bins by the rules of Sturges, Scott, Freedman-Diaconis and square root.
    A group may be a whole table. Nulls, NaN and infinities are left out."""
    values = finite(values, v)
    found = values.groupBy(F.struct(*by).alias("g")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("s"))
    quartiles = grouped_quantiles(values, by, v, [0.25, 0.75]).select(F.struct(*by).alias("g"), F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("q3"))
    found = found.join(quartiles, "g", "left").select("g.*", "n", "lo", "hi", "s", "q1", "q3")
    n, spread = F.col("n").cast("double"), F.col("hi") - F.col("lo")
    return found.select(
        *by, F.ceil(F.log2(n) + 1).cast("long").alias("sturges"),
        F.ceil(F.try_divide(spread, 3.5 * F.col("s") * F.pow(n, F.lit(-1 / 3)))).cast("long").alias("scott"),
        F.ceil(F.try_divide(spread, 2.0 * (F.col("q3") - F.col("q1")) * F.pow(n, F.lit(-1 / 3)))).cast("long").alias("freedman_diaconis"),
        F.ceil(F.sqrt(n)).cast("long").alias("square_root"),
    )


def histogram_mode(values: DataFrame, by: list[str], v: str, n_bins: int) -> DataFrame:
    """The middle of the fullest of equal bins for each group; the lowest of equally full ones. Nulls,
    NaN and infinities are left out."""
    values = finite(values, v)
    extent = values.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    placed = values.join(extent, by).withColumn("b", F.least(F.floor(F.coalesce(F.try_divide((F.col(v) - F.col("lo")) * n_bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(n_bins - 1)))
    counts = placed.groupBy(*by, "lo", "hi", "b").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by, "lo", "hi").agg(F.max(F.struct("n", (-F.col("b")).alias("nb"))).alias("m"))
    return best.select(*by, (F.col("lo") + (F.col("hi") - F.col("lo")) * (0.5 - F.col("m.nb")) / n_bins).alias("mode"))
