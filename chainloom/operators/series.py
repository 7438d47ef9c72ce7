"""Shaping of series sets: rows ``(series_id, label, x)`` or long rows with a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_arrays(df: DataFrame, id_col: str, array_col: str, label_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("series_id"), F.col(label_col).alias("label"), F.transform(array_col, lambda v: v.cast("double")).alias("x"))


def spread(series: DataFrame) -> DataFrame:
    """For heavy work on each row: a table of fewer partitions than there are cores is dealt out to all of them
    (by a hash of the id); a larger one stays where it is read."""
    cores = series.sparkSession.sparkContext.defaultParallelism
    return series if series.rdd.getNumPartitions() >= cores else series.repartition(cores, F.xxhash64("series_id"))


def of_class(series: DataFrame, label: int) -> DataFrame:
    return series.filter(F.col("label") == label)


def head_of(series: DataFrame, horizon: int) -> DataFrame:
    """The values before the last ``horizon``: what a forecast is conditioned on."""
    return series.withColumn("x", F.slice("x", 1, F.size("x") - horizon))


def tail_of(series: DataFrame, horizon: int) -> DataFrame:
    return series.withColumn("x", F.slice("x", F.size("x") - horizon + 1, horizon))


def relabelled(series: DataFrame, to: dict[int, int]) -> DataFrame:
    label = F.lit(None).cast("int")
    for old, new in to.items():
        label = F.when(F.col("label") == old, new).otherwise(label)
    return series.withColumn("label", label)


def problems(series: DataFrame) -> DataFrame:
    """One row: lengths met, classes, null labels; what a training set is asserted by."""
    return series.agg(
        F.min(F.size("x")).alias("least_length"), F.max(F.size("x")).alias("greatest_length"),
        F.count_distinct("label").alias("n_classes"), F.sum(F.col("label").isNull().cast("long")).alias("null_labels"),
        F.sum(F.exists("x", lambda v: v.isNull()).cast("long")).alias("series_with_nulls"),
    )


def asserted(series: DataFrame) -> int:
    """The common length of the series; raises ``ValueError`` if they can't be trained on."""
    found = problems(series).first()
    if found.least_length is None:
        raise ValueError("there are no series")
    if found.least_length != found.greatest_length or found.null_labels or found.series_with_nulls:
        raise ValueError(f"series differ in length or hold nulls: {found.asDict()}")
    return found.least_length


def long_form(series: DataFrame) -> DataFrame:
    return series.select("series_id", "label", F.posexplode("x").alias("t", "v"))


def array_form(long: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    return long.groupBy("series_id", "label").agg(F.transform(ordered, lambda s: s["v"]).alias("x"))


def daily_windows(events: DataFrame, ts: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, day, label, x): hourly means of a day of each key (a household, say) as 24 values, label 1 at
    the weekend. Hours without events take the last hour before them that day (the first one after, at its start)."""
    by = [*(keys or []), "day"]
    hours = events.groupBy(*(keys or []), F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.avg(value).alias("v"))
    known = hours.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("at"))  # at most 24

    def filled(h: Column) -> Column:
        before = F.filter(F.reverse(F.array_sort(F.map_keys("at"))), lambda k: k <= h)
        after = F.array_sort(F.map_keys("at"))
        return F.try_element_at("at", F.when(F.size(before) > 0, before[0]).otherwise(after[0]))

    x = F.transform(F.sequence(F.lit(0), F.lit(23)), filled)
    return known.select(*by, F.dayofweek("day").isin(1, 7).cast("int").alias("label"), x.alias("x"))


def sorted_by_class(series: DataFrame) -> DataFrame:
    return series.orderBy("label", "series_id")


def shuffled(series: DataFrame, seed: int) -> DataFrame:
    return series.orderBy(F.xxhash64(F.lit(seed), "series_id"), "series_id")


SLICE_ROWS = 250_000


def slice_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below a key: blocks of cuts first, then the cuts of one block, so that a row
    is compared with about twice the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    numbers = F.array(*[F.lit(c) for c in cuts])
    firsts = F.array(*[F.lit(c) for c in cuts[::width]])
    block = F.size(F.filter(firsts, lambda c: c < key)) - 1
    return F.when(block < 0, 0).otherwise(block * width + F.size(F.filter(F.slice(numbers, F.greatest(block, F.lit(0)) * width + 1, width), lambda c: c < key)))


def class_ranks(series: DataFrame, order: Column, slices: int | None = None) -> DataFrame:
    """(series_id, label, rank): the place (from 0) within the class by ``order``, ties by id.

    A class isn't gathered in one task: ``order`` (a bigint column) is cut into slices of about
    equal counts at its quantiles (of ``SLICE_ROWS`` rows, 8 at least), so ids in clusters are spread too; rows are ranked within
    (class, slice), and the sums of the slices before are added to that. Rows of one value
    of ``order`` share a slice.
    """
    keyed = series.select("series_id", "label", order.cast("long").alias("key"))
    slices = slices or max(8, -(-keyed.count() // SLICE_ROWS))
    cuts = sorted(set(keyed.approxQuantile("key", [k / slices for k in range(1, slices)], 0.25 / slices))) if slices > 1 else []  # ``slices`` numbers
    keyed = keyed.withColumn("slice", slice_of(F.col("key"), [min(int(c), (1 << 63) - 1) for c in cuts]))
    sizes = keyed.groupBy("label", "slice").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("slice")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("label", "slice").orderBy("key", "series_id"))
    placed = keyed.withColumn("within", within).join(before, ["label", "slice"])
    return placed.select("series_id", "label", (F.col("before") + F.col("within") - 1).alias("rank"))


def hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "series_id")


def sampled_per_class(series: DataFrame, k: int, order: Column) -> DataFrame:
    return series.join(class_ranks(series, order).filter(F.col("rank") < k).select("series_id"), "series_id", "left_semi")


def balanced(series: DataFrame, order: Column) -> DataFrame:
    """As many series of each class as the smallest class has."""
    least = series.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    return sampled_per_class(series, least, order)


def stacked(series: DataFrame, groups: dict[int, int], order: Column) -> DataFrame:
    """Series of several labels under the new labels of ``groups``, as many of each new label as the smallest has
    (the first by ``order`` over all its old labels); other labels are left out. An id may stand once only."""
    return balanced(relabelled(series, groups).filter("label IS NOT NULL"), order)


def stratified_folds(series: DataFrame, k: int, order: Column) -> DataFrame:
    """(series_id, label, fold): folds 1 to k, dealt in turn within each class."""
    return class_ranks(series, order).select("series_id", "label", (F.col("rank") % k + 1).cast("int").alias("fold"))


def stratified_split(series: DataFrame, share: float, order: Column) -> DataFrame:
    """Adds ``split``: the first ``share`` of each class is validation, the rest train."""
    ranks = class_ranks(series, order)
    sizes = series.groupBy("label").agg(F.count("*").alias("n"))
    chosen = ranks.join(sizes, "label").filter(F.col("rank") < F.round(F.col("n") * share)).select("series_id", F.lit("validation").alias("split"))
    return series.join(chosen, "series_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def random_split(series: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """Adds ``split`` by a hash of the id."""
    u, split, upto = (F.shiftrightunsigned(hashed(seed), 11).cast("double") + 0.5) / float(1 << 53), F.lit(None).cast("string"), 1.0
    for name, share in reversed(list(shares.items())):
        upto -= share
        split = F.when(u >= max(upto, 0.0), F.coalesce(split, F.lit(name))).otherwise(split)
    return series.withColumn("split", split)


def folds(series: DataFrame, k: int) -> DataFrame:
    """(series_id, fold): runs of the ids in order, 1 to k, as equal as can be."""
    whole = series.select("series_id", F.lit(0).alias("label"))
    n = whole.count()
    ranks = class_ranks(whole, F.col("series_id"))
    big, size = n % k, n // k
    r = F.col("rank")
    fold = F.when(r < big * (size + 1), F.floor(r / (size + 1))).otherwise(big + F.floor((r - big * (size + 1)) / F.greatest(F.lit(size), F.lit(1))))
    return ranks.select("series_id", (fold + 1).cast("int").alias("fold"))


def class_counts(series: DataFrame) -> DataFrame:
    return series.groupBy("label").agg(F.count("*").alias("n"))


def label_index(*sets: DataFrame) -> DataFrame:
    """(label, label_index): labels of all sets in order, from 1; one row for each class."""
    labels = sets[0].select("label")
    for s in sets[1:]:
        labels = labels.unionByName(s.select("label"))
    return labels.distinct().select("label", F.dense_rank().over(Window.orderBy("label")).alias("label_index"))


def is_balanced(series: DataFrame) -> DataFrame:
    return class_counts(series).agg((F.min("n") == F.max("n")).alias("balanced"), F.count("*").alias("n_classes"))


def complement(series: DataFrame, chosen: DataFrame) -> DataFrame:
    return series.join(chosen.select("series_id"), "series_id", "left_anti")
