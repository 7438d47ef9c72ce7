"""Exact quantiles of a column of any size, in a few passes of bounded aggregates.

Spark's ``percentile`` keeps every distinct value of a group in memory. Here each
pass counts values in bins of the range that still holds a wanted rank and narrows
that range to one bin, until few values are left; only those are gathered.

The first pass takes bins of equal width. If the range that is left still spans more than a
factor of two, the next one takes a bin for each power of two (``log_place``), after which bins of
equal width cut a range of at most 2**52 doubles by ``BINS`` each time: ``PASSES`` are never exceeded,
whatever the values. Infinities are counted apart; NaN are left out like nulls.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.shared import forget, written

BINS, FEW, PASSES = 2048, 4096, 9
INF = float("inf")


def _inside(lo: float, hi: float):
    return (F.col("v") >= lo) & (F.col("v") <= hi)


def linear_place(v: Column, lo: Column, hi: Column, n_bins: int) -> Column:
    """The bin (from 0) among ``n_bins`` of equal width of [lo, hi]; halves are taken where the width would overflow."""
    s = F.when(F.greatest(F.abs(lo), F.abs(hi)) > 1e300, 0.5).otherwise(1.0)
    width = F.greatest((hi * s - lo * s) / n_bins, F.lit(5e-324))
    return F.least(F.greatest(F.floor((v * s - lo * s) / width), F.lit(0).cast("long")), F.lit(n_bins - 1).cast("long"))


def log_place(v: Column) -> Column:
    """A bin for each sign and power of two, in the order of the values; about 4,200 in all."""
    size = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v < 0, -size).otherwise(size))


def wide_range(lo, hi):
    """Whether a range holds 0 within or spans more than a factor of two; of numbers or columns."""
    return ((lo <= 0) & (hi > 0)) | ((lo > 0) & (hi / 2 > lo)) | ((hi <= 0) & (lo < hi) & (lo / 2 < hi))


def between(a: float, b: float, part: float) -> float:
    """The value at a part of the way from a to b; NaN between the two infinities."""
    if part == 0 or a == b:
        return a
    return a + (b - a) * part if math.isfinite(b - a) else a * (1 - part) + b * part


def _bins(df: DataFrame, lo: float, hi: float, by_powers: bool) -> list:
    """(count, least, greatest) of the bins of [lo, hi] that hold values, in order."""
    b = log_place(F.col("v")) if by_powers else linear_place(F.col("v"), F.lit(lo), F.lit(hi), BINS)
    return df.filter(_inside(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()


def order_statistics(df: DataFrame, ranks: list[int], lo: float, hi: float, n: int) -> dict[int, float]:
    """Values of the column ``v`` (finite) by rank from 0. Ranks that lie in one range share its passes."""
    at = {r: (lo, hi, n, 0) for r in ranks}  # range, count in it, count below it
    for turn in range(PASSES + 1):
        wide = {x[:2] for x in at.values() if x[0] < x[1] and x[2] > FEW}
        if not wide:
            break
        if turn == PASSES:
            raise ArithmeticError(f"ranges {sorted(wide)} were not narrowed")
        for span in wide:
            bins = _bins(df, *span, by_powers=turn > 0 and bool(wide_range(*span)))
            for r in [r for r, x in at.items() if x[:2] == span]:
                below = at[r][3]
                for row in bins:
                    if below + row.n > r:
                        at[r] = (row.lo, row.hi, row.n, below)
                        break
                    below += row.n
    few = {x[:2] for x in at.values() if x[0] < x[1]}
    values: list[float] = []
    if few:
        values = sorted(r.v for r in df.filter(reduce(or_, (_inside(*x) for x in sorted(few)))).select("v").collect())  # at most FEW for each rank
    return {r: x[0] if x[0] == x[1] else values[bisect_left(values, x[0]) + r - x[3]] for r, x in at.items()}


def exact_quantiles(df: DataFrame, column, probabilities: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the values that are neither null nor NaN; None for each if there are none."""
    values = df.select((column.cast("double") + 0.0).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    finite = F.when(F.abs("v") < INF, F.col("v"))
    n, low, lo, hi, held = values.agg(F.count("*"), F.count_if(F.col("v") == -INF), F.min(finite), F.max(finite), F.count(finite)).first()
    if not n:
        return [None] * len(probabilities)
    ranks = sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    inner = [r - low for r in ranks if low <= r < low + held]
    found = order_statistics(values.filter(F.abs("v") < INF), inner, lo, hi, held) if inner else {}
    at = {r: -INF if r < low else found[r - low] if r < low + held else INF for r in ranks}
    return [between(at[math.floor(p * (n - 1))], at[math.ceil(p * (n - 1))], p * (n - 1) - math.floor(p * (n - 1))) for p in probabilities]


GROUP_BINS, GROUP_FEW = 1024, 1024


def grouped_order_statistics(df: DataFrame, by: list[str], column: str, ranks: Callable[[Column], Column], weight: str | None = None) -> DataFrame:
    """(by, n, x): the values of ``column`` at the ranks (from 0, an array made of the group's count) of every group.

    Like ``order_statistics``, with the ranges of all groups as a table: each pass counts values in bins of
    the ranges that are still wide, and at most ``GROUP_FEW`` values of a range are gathered at the end. Nulls
    and NaN are left out, infinities are counted apart; a null key is a group.

    With ``weight``, a column of whole numbers that are 0 or more, a row counts that often: ``n`` is the sum of the
    weights, and ranks are places among as many copies. Rows of a null weight, or of 0, are left out.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(F.struct(*by).alias("g"), (F.col(column).cast("double") + 0.0).alias("v"), w.alias("w")).filter("v IS NOT NULL AND NOT isnan(v) AND w > 0")
    finite, total = F.abs("v") < INF, lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0).cast("long"))
    extent = rows.groupBy("g").agg(
        F.sum("w").alias("n"), total(F.col("v") == -INF).alias("low"), total(finite).alias("held"), F.count_if(finite).alias("rows"),
        F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"),
    )
    rank, upper = F.col("rank"), F.col("low") + F.col("held")
    edge = F.when(rank < F.col("low"), -INF).when(rank >= upper, INF)
    hi = F.when(rank.isNull(), F.col("lo")).otherwise(F.coalesce(edge, F.col("hi")))  # a group without ranks has nothing to narrow
    wanted = extent.withColumn("rank", F.explode_outer(F.array_distinct(ranks(F.col("n"))))).select(
        "g", "n", "rank", F.coalesce(edge, F.col("lo")).alias("lo"), hi.alias("hi"), "rows", F.col("low").alias("below")
    )
    rows, wanted = rows.filter(finite), written(wanted, "ranks")
    wide = (F.col("lo") < F.col("hi")) & (F.col("rows") > GROUP_FEW)
    for turn in range(PASSES + 1):
        if wanted.filter(wide).isEmpty():
            break
        if turn == PASSES:
            raise ArithmeticError("the ranges of some groups were not narrowed")
        lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
        place = linear_place(v, lo, hi, GROUP_BINS)
        place = F.when(wide_range(lo, hi), log_place(v)).otherwise(place) if turn else place
        spans = wanted.filter(wide).select("g", "lo", "hi").distinct()
        inside = rows.join(spans, "g").filter("v BETWEEN lo AND hi").withColumn("b", place)
        bins = inside.groupBy("g", "lo", "hi", "b").agg(F.sum("w").alias("w_bin"), F.count("*").alias("n_bin"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        bins = bins.withColumn("upto", F.sum("w_bin").over(Window.partitionBy("g", "lo", "hi").orderBy("b")))  # some thousand rows at most
        at = F.col("rank") - F.col("below")
        found = wanted.filter(wide).join(bins, ["g", "lo", "hi"]).filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("w_bin")))
        found = found.select("g", "n", "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("n_bin").alias("rows"), (F.col("below") + F.col("upto") - F.col("w_bin")).alias("below"))
        before, wanted = wanted, written(wanted.filter(~wide).unionByName(found), "ranks")
        forget(before)
    few = rows.join(wanted.filter("lo < hi").select("g", "lo", "hi").distinct(), "g").filter("v BETWEEN lo AND hi")
    if weight:  # where the copies of each value end
        few = few.withColumn("upto", F.sum("w").over(Window.partitionBy("g", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        few = few.groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("upto", "v"))).alias("vs"))
        found = F.expr("vs[size(filter(vs, x -> x.upto <= rank - below))].v")
    else:
        few = few.groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found = F.try_element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int"))
    value = F.coalesce(found, F.col("lo"))
    values = wanted.join(few, ["g", "lo", "hi"], "left").groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.when(rank.isNotNull(), F.struct("rank", value.alias("x"))))).alias("x"))
    return values.select("g.*", "n", F.transform(ranks(F.col("n")), lambda r: F.element_at("x", r)).alias("x"))


def grouped_quantiles(df: DataFrame, by: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """(by, n, quantiles): linearly interpolated quantiles of the values of every group that are neither null nor NaN."""
    at = lambda p, n: F.lit(float(p)) * (n - 1)
    ranks = lambda n: F.array(*[f(at(p, n)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    found, x = grouped_order_statistics(df, by, column, ranks), F.col("x")

    def of(k: int, p: float) -> Column:
        a, b, part = x[2 * k], x[2 * k + 1], at(p, F.col("n")) - F.floor(at(p, F.col("n")))
        return F.when((part == 0) | (a == b), a).when(F.abs(b - a) < INF, a + (b - a) * part).otherwise(a * (1 - part) + b * part)

    return found.select(*by, "n", F.array(*[of(k, p) for k, p in enumerate(probabilities)]).alias("quantiles"))
