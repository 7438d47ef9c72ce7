"""Grids of hyper-parameters: cells still to do, resumable runs, and the tables made of them.

A cell is trained by Spark jobs over the whole data (``training.fit``); its result is
appended to the result table, and a restart leaves out the cells that are in it.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions.fitted import takes_dimension
from chainloom.operators.series import hashed, stratified_folds
from chainloom.operators.training import Options, fit_scaled

CELL = ["fold", "rate", "d", "max_bond", "encoding"]
GRID_SCHEMA = "fold int, rate double, d int, max_bond int, encoding string"
RESULT_SCHEMA = GRID_SCHEMA + ", sweep int, train_accuracy double, train_kld double, test_accuracy double, test_kld double, seconds double, error string, run string"


def grid(spark: SparkSession, n_folds: int, rates: list[float], ds: list[int], bonds: list[int], encodings: list[str], most: int | None = None, inner_d: int = 2) -> DataFrame:
    """All valid cells; ``most`` bounds bond times dimension. Encodings may be composite, with ``inner_d`` components in a bin."""
    rows = [
        (f, float(r), d, b, e) for f, r, d, b, e in product(range(1, n_folds + 1), rates, ds, bonds, encodings)
        if takes_dimension(e, d, inner_d) and (most is None or b * d <= most)
    ]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def remaining(cells: DataFrame, done: DataFrame) -> DataFrame:
    return cells.join(done.select(*CELL).distinct(), CELL, "left_anti")


def run_of(n_folds: int, options: Options, seed: int) -> str:
    """What results must have in common to stand in one table: everything but the grid itself."""
    rest = {k: str(v) for k, v in sorted(vars(options).items()) if k not in CELL}
    return json.dumps({"n_folds": n_folds, "seed": seed} | rest)


def run_grid(series: DataFrame, cells: DataFrame, path: str, n_folds: int, options: Options, seed: int = 1, parallel: int = 1) -> DataFrame:
    """Trains every cell that ``path`` doesn't hold yet, in the order of their cost, ``parallel`` cells at a
    time, and returns the table. Results of a run with other parameters are refused."""
    spark, run = series.sparkSession, run_of(n_folds, options, seed)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        done = spark.read.parquet(path)
        if other := done.filter(F.col("run") != run).select("run").first():
            raise ValueError(f"{path} holds results of another run: {other.run}, not {run}")
        cells = remaining(cells, done)
    folds = stratified_folds(series, n_folds, hashed(seed)).select("series_id", "fold")
    dealt = series.join(folds, "series_id")

    def trained(cell) -> list[tuple]:
        train, test = dealt.filter(F.col("fold") != cell.fold).drop("fold"), dealt.filter(F.col("fold") == cell.fold).drop("fold")
        chosen = options.changed(rate=cell.rate, d=cell.d, max_bond=cell.max_bond, encoding=cell.encoding)
        key = tuple(cell[c] for c in CELL)
        try:
            log = fit_scaled(train, test, chosen)[1]
            return [(*key, x["sweep"], x["train_accuracy"], x["train_kld"], x["test_accuracy"], x["test_kld"], x["seconds"], None, run) for x in log]
        except FloatingPointError as error:
            return [(*key, None, None, None, None, None, None, str(error), run)]

    todo = cells.orderBy(F.col("max_bond") * F.col("d"), *CELL).collect()  # one row for each cell
    with ThreadPoolExecutor(parallel) as pool:  # the driver starts jobs, the cluster shares its cores among them
        for done in as_completed([pool.submit(trained, cell) for cell in todo]):  # written one after another
            spark.createDataFrame(done.result(), RESULT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_report(spark: SparkSession, path: str, options: Options, log: list[dict], confusion: DataFrame | None = None) -> None:
    """A text report: the options, a line for each sweep, and the confusion table."""
    lines = [f"{k} = {v}" for k, v in vars(options).items()]
    lines += ["; ".join(f"{k} {v:.6g}" for k, v in entry.items() if v is not None) for entry in log]
    if confusion is not None:
        lines += [f"true {r.truth}, predicted {r.predicted}: {r.n}" for r in confusion.orderBy("truth", "predicted").collect()]  # classes squared
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def fold_means(results: DataFrame, n_folds: int) -> DataFrame:
    """Means over the folds; null where a fold is missing."""
    keys = ["sweep", *CELL[1:]]
    complete = F.count("*") == n_folds
    return results.filter("error IS NULL").groupBy(*keys).agg(*[F.when(complete, F.avg(m)).alias(m) for m in ("train_accuracy", "train_kld", "test_accuracy", "test_kld")])


MEASURES = ("train_accuracy", "train_kld", "test_accuracy", "test_kld")
BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "^": F.pow}
UNARY = {"abs": F.abs, "sqrt": F.sqrt, "square": lambda a: a * a, "-": lambda a: -a}


def measured(results: DataFrame, measures=MEASURES) -> DataFrame:
    """The results with their measures as one column ``r``; null where one of them is missing or NaN."""
    whole = reduce(and_, (F.col(m).isNotNull() & ~F.isnan(m) for m in measures))
    return results.withColumn("r", F.when(whole, F.struct(*measures)))


def combined(op: str, a: Column, b: Column | float, measures=MEASURES) -> Column:
    """A struct of measures for two of them, or for one and a number, by + - * / or ^. If either is missing, or
    a part can't be worked out, so is the result."""
    of = lambda x, m: x[m] if isinstance(x, Column) else F.lit(float(x))
    return _complete({m: BINARY[op](of(a, m), of(b, m)) for m in measures})


def applied(op: str, a: Column, measures=MEASURES) -> Column:
    """abs, sqrt, square or - of every part of a struct of measures."""
    return _complete({m: UNARY[op](a[m]) for m in measures})


def _complete(parts: dict[str, Column]) -> Column:
    whole = reduce(and_, (p.isNotNull() & ~F.isnan(p) for p in parts.values()))
    return F.when(whole, F.struct(*[p.alias(m) for m, p in parts.items()]))


def summed(results: DataFrame, by: list[str], measures=MEASURES) -> DataFrame:
    """(by, r, n): the sum of the structs ``r`` of a group; missing if one of them is."""
    whole = F.count("*") == F.count("r")
    total = F.when(whole, F.struct(*[F.sum(F.col("r")[m]).alias(m) for m in measures]))
    return results.groupBy(*by).agg(total.alias("r"), F.count("*").alias("n"))


def fold_statistics(results: DataFrame, n_folds: int, measures=MEASURES) -> DataFrame:
    """(sweep, cell, mean, deviation) over the folds as structs of measures, missing where a fold or a part of one is."""
    keys = ["sweep", *CELL[1:]]
    rows = measured(results.filter("error IS NULL"), measures).select(*keys, "fold", "r")
    means = summed(rows, keys, measures)
    means = means.select(*keys, F.when(F.col("n") == n_folds, combined("/", F.col("r"), n_folds, measures)).alias("mean"))
    gaps = rows.join(means, keys).withColumn("r", applied("square", combined("-", F.col("r"), F.col("mean"), measures), measures))
    spread = summed(gaps, keys, measures).select(*keys, applied("sqrt", combined("/", F.col("r"), n_folds, measures), measures).alias("deviation"))
    return means.join(spread, keys)


def balanced_by_untrained(means: DataFrame, value: str = "test_kld") -> DataFrame:
    """``means`` (sweep, cell, measures) with ``balanced``: what the untrained chain of the same dimension, bond and
    encoding (sweep 0, any rate) has of a measure, less what the cell has; null without such a row."""
    own = ["d", "max_bond", "encoding"]
    base = means.filter("sweep = 0").groupBy(*own).agg(F.avg(value).alias("untrained"))
    return means.join(base, own, "left").withColumn("balanced", F.col("untrained") - F.col(value))


def sweep_table(results: DataFrame, measures=(*MEASURES, "seconds")) -> DataFrame:
    """(cell, measure, initial, sweeps, after_norm, mean): the measures of each run, with those after each sweep as an array in order;
    ``mean`` is over the sweeps, without what comes before and after training."""
    rows = results.filter("error IS NULL").select(*CELL, "sweep", F.explode(F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*measures))).alias("measure", "value"))
    runs = rows.groupBy(*CELL, "measure").agg(F.array_sort(F.collect_list(F.struct("sweep", "value"))).alias("s"))  # one entry for each sweep
    inner = F.transform(F.filter("s", lambda x: (x["sweep"] > 0) & (x["sweep"] < F.element_at("s", -1)["sweep"])), lambda x: x["value"])
    runs = runs.select(*CELL, "measure", F.element_at("s", 1)["value"].alias("initial"), inner.alias("sweeps"), F.element_at("s", -1)["value"].alias("after_norm"))
    return runs.withColumn("mean", F.when(F.size("sweeps") > 0, F.aggregate("sweeps", F.lit(0.0), lambda a, v: a + v) / F.size("sweeps")))


def training_curve(means: DataFrame, cell: dict, value: str = "test_accuracy") -> DataFrame:
    """(rate, sweep, value) of the cells that agree with ``cell``, in order: one curve for each rate."""
    chosen = reduce(and_, (F.col(k) == v for k, v in cell.items()), F.lit(True))
    return means.filter(chosen).select("rate", "sweep", value).orderBy("rate", "sweep")


def best_cells(means: DataFrame) -> DataFrame:
    """(criterion, cell, value): the best by accuracy and by KLD, ties by the smallest cell and sweep."""
    cell = F.struct("sweep", *CELL[1:])
    best = means.agg(
        F.min(F.struct((-F.col("test_accuracy")).alias("v"), cell.alias("cell"))).alias("a"), F.min(F.struct(F.col("test_kld").alias("v"), cell.alias("cell"))).alias("k")
    )
    rows = F.array(F.struct(F.lit("accuracy").alias("criterion"), F.col("a.cell").alias("cell"), (-F.col("a.v")).alias("value")), F.struct(F.lit("kld").alias("criterion"), F.col("k.cell").alias("cell"), F.col("k.v").alias("value")))
    return best.select(F.explode(rows).alias("r")).select("r.criterion", "r.cell.*", "r.value")


def sweep_changes(results: DataFrame) -> DataFrame:
    """The results with the change of the KLD since the sweep before."""
    return results.withColumn("change", F.col("test_kld") - F.lag("test_kld").over(Window.partitionBy(*CELL).orderBy("sweep")))


def heat_map(means: DataFrame, rows: str, columns: str, value: str, values: list) -> DataFrame:
    return means.groupBy(rows).pivot(columns, values).agg(F.max(value))


def regular_axes(results: DataFrame, x: str, xs: list, y: str, ys: list) -> DataFrame:
    """Every place of the two axes, with the results where there are any."""
    spark = results.sparkSession
    axes = spark.createDataFrame(list(product(xs, ys)), f"{x} {dict(results.dtypes)[x]}, {y} {dict(results.dtypes)[y]}")
    return axes.join(results, [x, y], "left")
