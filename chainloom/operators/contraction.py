"""Tensor contraction as relational algebra, and scoring of short chains.

A tensor is a table of its entries that aren't 0: index columns and ``v`` (real) or
``re, im``. Contracting shared indices is an equi-join on them and a sum over the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contract(a: DataFrame, b: DataFrame, value: str = "v", batch: tuple = ()) -> DataFrame:
    """Sums over the index columns that both tables have; shared columns of ``batch`` are kept."""
    left, right = [c for c in a.columns if c != value], [c for c in b.columns if c != value]
    shared = [c for c in left if c in right]
    kept = [c for c in left if c in batch or c not in shared] + [c for c in right if c not in shared]
    joined = a.withColumnRenamed(value, "__a").join(b.withColumnRenamed(value, "__b"), shared)
    return joined.groupBy(*kept).agg(F.sum(F.col("__a") * F.col("__b")).alias(value))


def fold_chain(phi: Column, tensor) -> Column:
    """Left to right contraction of a uniform chain of bond 2 with local vectors of size 2.

    ``phi``: array of arrays of 2; ``tensor``: [l][s][r] numbers of every site. Starts and
    ends at bond index 0. For small bonds this stays in the JVM.
    """
    w = tensor

    def step(acc: Column, p: Column) -> Column:
        return F.array(*[sum((acc[i] * p[s] * float(w[i][s][r]) for i in range(2) for s in range(2)), F.lit(0.0)) for r in range(2)])

    return F.aggregate(phi, F.array(F.lit(1.0), F.lit(0.0)), step)


def contract_complex(a: DataFrame, b: DataFrame, on: list[str], by: list) -> DataFrame:
    """``contract`` of complex entries (re, im): joined on ``on``, summed by ``by`` (columns of either side, with names)."""
    joined = a.withColumnsRenamed({"re": "__re", "im": "__im"}).join(b, on)
    re, im = F.col("__re") * F.col("re") - F.col("__im") * F.col("im"), F.col("__re") * F.col("im") + F.col("__im") * F.col("re")
    return joined.groupBy(*by).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


TASK_SERIES = 4096


def dealt(series: DataFrame) -> DataFrame:
    """Series dealt out by a hash of their ids, about ``TASK_SERIES`` to a task: what a task contracts doesn't grow with the
    input, and all sums of ``pairs_contracted`` are made where the series are, without another shuffle."""
    return series.repartition(max(1, -(-series.count() // TASK_SERIES)), "series_id")


def pairs_contracted(state: DataFrame, length: int) -> DataFrame:
    """(series_id, l, r, c, re, im) of series_id, t, l, r, c, re, im with ``length`` sites: neighbouring sites meet in a group of
    their own, are joined on the index between them and summed over it, in log2(length) rounds. Each round reads the one before once."""
    entry, n = F.struct((F.col("t") % 2 == 1).alias("odd"), "l", "r", "c", "re", "im"), length
    product = lambda a, b: F.struct(a["l"].alias("l"), b["r"].alias("r"), F.coalesce(a["c"], b["c"]).alias("c"), (a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))
    while n > 1:
        met = state.groupBy("series_id", F.expr("t div 2").cast("int").alias("t")).agg(F.collect_list(entry).alias("e"))  # entries of two sites
        met = met.select("series_id", "t", F.filter("e", lambda x: ~x["odd"]).alias("left"), F.filter("e", lambda x: x["odd"]).alias("right"))
        joined = F.flatten(F.transform("left", lambda a: F.transform(F.filter("right", lambda b: b["l"] == a["r"]), lambda b: product(a, b))))
        if n % 2:  # the last site has no neighbour
            alone = F.transform("left", lambda a: F.struct(*[a[k].alias(k) for k in ("l", "r", "c", "re", "im")]))
            joined = F.when(F.col("t") == n // 2, alone).otherwise(joined)
        state = met.select("series_id", "t", F.inline(joined)).groupBy("series_id", "t", "l", "r", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        n = (n + 1) // 2
    return state.select("series_id", "l", "r", "c", "re", "im")


def relational_amplitudes(local: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """(series_id, c, re, im): every series contracted with a chain by joins and sums alone.

    ``local``: series_id, t, k, re, im (``encodings.encoded``, best of ``dealt`` series), which is conjugated; ``entries``: a model
    table's site, l, s, r, c, re, im, which is bounded and sent to the tasks. Neighbouring sites are contracted in pairs.
    """
    phi = local.select("series_id", "t", F.col("k").alias("s"), "re", (-F.col("im")).alias("im"))
    chain = entries.filter("l IS NOT NULL").select(F.col("site").alias("t"), "l", "s", "r", "c", "re", "im")
    state = contract_complex(phi, F.broadcast(chain), ["t", "s"], ["series_id", "t", "l", "r", "c"])
    return pairs_contracted(state, length).select("series_id", "c", "re", "im")


def disagreeing(weights: DataFrame, amplitudes: DataFrame, tolerance: float = 2.0**-26) -> DataFrame:
    """(series_id, c, weight, relational) of the classes of series for which two routes of contraction differ: squared
    amplitudes of arrays (``prediction.scores``) and those of ``relational_amplitudes``; a missing one is 0."""
    long = weights.select("series_id", F.posexplode("weight").alias("c", "weight"))
    other = amplitudes.select("series_id", "c", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("relational"))
    both = long.join(other, ["series_id", "c"], "full").fillna(0.0, ["weight", "relational"])
    return both.filter(~(F.abs(F.col("weight") - F.col("relational")) <= tolerance * F.greatest("weight", "relational")))
