"""Local feature maps of one value, as column expressions.

An encoding turns a value into d components. Complex components are structs
``(re, im)``; real encodings give plain doubles. Each entry of ``ENCODINGS`` names its
range, whether it is complex, and what dimensions it takes; values outside the
range are an error for the whole data set (``checked``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.quantiles import grouped_order_statistics

PI = math.pi
UNROLLED = 6


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def c_abs2(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def c_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def angle(v: Column, d: int = 2, periods: float = 0.25) -> list[Column]:
    """exp(+-3 i pi v / 2) times cosine and sine of 2 pi v ``periods``."""
    half, turn = v * (2 * PI * periods), v * (1.5 * PI)
    c, s = F.cos(half), F.sin(half)
    return [complex_of(c * F.cos(turn), c * F.sin(turn)), complex_of(s * F.cos(turn), -s * F.sin(turn))]


def half_angle(v: Column, d: int = 2) -> list[Column]:
    return [F.cos(v * (PI / 2)), F.sin(v * (PI / 2))]


def qudit(v: Column, d: int = 3) -> list[Column]:
    phi, theta = F.atan(v), F.acos(v)
    return [
        F.cos(theta) * (F.cos(phi) + F.sin(phi)) / math.sqrt(2),
        F.cos(theta) * (F.cos(phi) - F.sin(phi)) / math.sqrt(2),
        F.sin(theta),
    ]


def linear(v: Column, d: int = 2) -> list[Column]:
    return [F.sqrt(1.0 - v), F.sqrt(v)]


def fourier_frequencies(d: int) -> list[int]:
    """0, 1, -1, 2, -2, ..."""
    return [(k + 1) // 2 * (1 if k % 2 else -1) for k in range(d)]


def fourier(v: Column, d: int, frequencies: list[int] | None = None) -> list[Column]:
    """exp(i pi k v) / sqrt(d) for each frequency k."""
    ks = frequencies or fourier_frequencies(d)
    return [complex_of(F.cos(v * (PI * k)) / math.sqrt(len(ks)), F.sin(v * (PI * k)) / math.sqrt(len(ks))) for k in ks]


def sahand(v: Column, d: int) -> list[Column]:
    """d / 2 intervals of equal width; within its interval a pair of angle components, else 0."""
    width, parts = 2.0 / d, []
    for m in range(d // 2):
        start = m * width
        inside = (v >= F.lit(start)) & (v <= F.lit(start + width))
        turn, half = v * (1.5 * PI / width), (v - F.lit(start)) * (PI / 2 / width)
        zero = F.lit(0.0)
        for size, sign in ((F.cos(half), 1.0), (F.sin(half), -1.0)):
            parts.append(complex_of(F.when(inside, size * F.cos(turn)).otherwise(zero), F.when(inside, sign * size * F.sin(turn)).otherwise(zero)))
    return parts


def legendre_polynomial(v: Column, degree: int) -> Column:
    before, now = F.lit(1.0), v
    if degree == 0:
        return before
    if degree > UNROLLED:  # written out, the expression would grow with a power of the degree
        first = F.struct(before.alias("before"), v.cast("double").alias("now"))
        step = lambda a, n: F.struct(a["now"].alias("before"), ((v * a["now"] * (2.0 * n + 1.0) - a["before"] * n.cast("double")) / (n + 1.0)).alias("now"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(degree - 1)), first, step, lambda a: a["now"])
    for n in range(1, degree):
        before, now = now, (v * now * float(2 * n + 1) - before * float(n)) / float(n + 1)
    return now


def legendre(v: Column, d: int, degrees: list[int] | None = None, norm: bool = True) -> list[Column]:
    """sqrt((2 l + 1) / 2) P_l(v) for each degree; ``norm`` divides by the square root of d times
    the value at 1 of the function of degree d (of the greatest degree, if degrees are given)."""
    ls = degrees or list(range(d))
    top = max(ls) if degrees else d
    by = math.sqrt(math.sqrt((2 * top + 1) / 2) * len(ls)) if norm else 1.0
    return [legendre_polynomial(v, n) * (math.sqrt((2 * n + 1) / 2) / by) for n in ls]


def fourier_by_list(v: Column, ks: Column) -> Column:
    """Array of exp(i pi k v) / sqrt(d) for the frequencies of a column, which may differ by time point."""
    size = F.sqrt(F.size(ks).cast("double"))
    return F.transform(ks, lambda k: complex_of(F.cos(v * (PI * k)) / size, F.sin(v * (PI * k)) / size))


def legendre_by_list(v: Column, ls: Column, most: int, norm: bool = True) -> Column:
    """Array of the normalised Legendre functions of the degrees of a column, up to ``most``."""
    values = F.array(*[legendre_polynomial(v, n) * math.sqrt((2 * n + 1) / 2) for n in range(most + 1)])
    by = F.sqrt(F.sqrt((2 * F.array_max(ls) + 1) / 2) * F.size(ls)) if norm else F.lit(1.0)
    return F.transform(ls, lambda l: complex_of(values[l] / by, F.lit(0.0)))


def by_time(series: DataFrame, lists: DataFrame, make: Callable[[Column, Column], Column]) -> DataFrame:
    """(series_id, t, k, re, im): ``make`` of each value and the list of its time point. ``lists``: t, ks (one row for a time point)."""
    long = series.select("series_id", F.posexplode("x").alias("t", "v")).join(lists, "t")
    z = long.select("series_id", "t", F.posexplode(make(F.col("v"), F.col("ks"))).alias("k", "z"))
    return z.select("series_id", "t", "k", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def number_states(symbols: DataFrame, number: Column, d: int) -> DataFrame:
    """(series_id, t, k, re, im): the basis state of each symbol's number (0 to d - 1), as letters (a is 0) and
    bits are encoded. A symbol outside fails the query. ``symbols``: series_id, t."""
    fits = F.when(number.between(0, d - 1), number).otherwise(F.raise_error(F.lit(f"a symbol has no state among {d}")).cast("int"))
    states = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.when(k == F.col("number"), 1.0).otherwise(0.0))
    long = symbols.withColumn("number", fits).select("series_id", "t", F.posexplode(states).alias("k", "re"))
    return long.withColumn("im", F.lit(0.0))


def letter_number(symbol: Column) -> Column:
    return F.ascii(symbol) - 97


def uniform(v: Column, d: int) -> list[Column]:
    return [F.lit(1.0 / d) for _ in range(d)]


def rect(u: Column) -> Column:
    return F.when(F.abs(u) == 0.5, 0.5).when(F.abs(u) < 0.5, 1.0).otherwise(0.0)


def split_on_edges(v: Column, edges: Column, n_bins: int, inner: Callable, inner_d: int) -> list[Column]:
    """For each bin, the inner encoding of the place within the bin, weighted by ``rect``;
    a bin of no width weighs 0."""
    parts = []
    for k in range(n_bins):
        a, b = edges[k], edges[k + 1]
        u = F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))
        weight = F.when(b > a, rect(u - 0.5)).otherwise(0.0)
        parts += [complex_of(weight * p["re"], weight * p["im"]) if inner in COMPLEX else weight * p for p in inner(u, inner_d)]
    return parts


def uniform_edges(n_bins: int, low: float, high: float) -> Column:
    return F.array(*[F.lit(low + (high - low) * k / n_bins) for k in range(n_bins + 1)])


def histogram_edges(series: DataFrame, n_bins: int, low: float, high: float, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(by, t, edges): for each time point (of each group) edges of bins of equal counts, halfway between the
    neighbouring values at each multiple of the step; edges that aren't reached are ``high``.

    ``weight``: a column of whole numbers; a series counts that often. The neighbours are order
    statistics, found by counts in bins: no time point is gathered.
    """
    keys = [*by, "t"]
    long = series.select(*by, *([weight] if weight else []), F.posexplode("x").alias("t", "v"))
    step = lambda n: F.greatest(F.bround(n / n_bins).cast("long"), F.lit(1).cast("long"))
    ks = F.transform(F.sequence(F.lit(1), F.lit(max(n_bins - 1, 1))), lambda k: k.cast("long"))
    inner_ks = lambda n: F.filter(ks, lambda k: (k < n_bins) & (k * step(n) < n))
    ranks = lambda n: F.flatten(F.transform(inner_ks(n), lambda k: F.array(k * step(n) - 1, k * step(n))))
    found = grouped_order_statistics(long, keys, "v", ranks, weight)
    pairs = F.transform(F.sequence(F.lit(1), F.size("x"), F.lit(2)), lambda i: (F.element_at("x", i) + F.element_at("x", i + 1)) / 2)
    inner = F.when(F.size("x") > 0, pairs).otherwise(F.array().cast("array<double>"))
    padded = F.concat(F.array(F.lit(float(low))), inner, F.array_repeat(F.lit(float(high)), F.lit(n_bins) - F.size(inner)))
    return found.select(*keys, padded.alias("edges"))


@dataclass(frozen=True)
class Encoding:
    name: str
    low: float
    high: float
    is_complex: bool
    make: Callable[..., list[Column]]
    dimensions: Callable[[int], bool] = lambda d: d >= 1


ENCODINGS = {
    e.name: e
    for e in (
        Encoding("stoudenmire", 0.0, 1.0, True, angle, lambda d: d == 2),
        Encoding("half_angle", 0.0, 1.0, False, half_angle, lambda d: d == 2),
        Encoding("qudit", -1.0, 1.0, False, qudit, lambda d: d == 3),
        Encoding("linear", 0.0, 1.0, False, linear, lambda d: d == 2),
        Encoding("fourier", -1.0, 1.0, True, fourier),
        Encoding("sahand", 0.0, 1.0, True, sahand, lambda d: d % 2 == 0),
        Encoding("legendre", -1.0, 1.0, False, legendre),
        Encoding("legendre_no_norm", -1.0, 1.0, False, lambda v, d: legendre(v, d, norm=False)),
        Encoding("uniform", 0.0, 1.0, False, uniform),
    )
}
COMPLEX = frozenset(e.make for e in ENCODINGS.values() if e.is_complex)


def checked(series: DataFrame, encoding) -> DataFrame:
    """Fails the query when a value is outside the encoding's range."""
    fits = F.forall("x", lambda v: (v >= encoding.low) & (v <= encoding.high))
    said = F.lit(f"a value is outside [{encoding.low}, {encoding.high}], the range of {encoding.name}")
    return series.withColumn("x", F.when(fits, F.col("x")).otherwise(F.raise_error(said).cast("array<double>")))


def encoded(series: DataFrame, name: str, d: int) -> DataFrame:
    """(series_id, t, k, re, im): the components of each value, k from 0."""
    encoding = ENCODINGS[name]
    if not encoding.dimensions(d):
        raise ValueError(f"{name} takes no dimension {d}")
    # checked after the explode: Spark moves filters that it infers of one below joins and filters, to rows that aren't meant
    long = series.select("series_id", F.posexplode("x").alias("t", "v"))
    said = F.lit(f"a value is outside [{encoding.low}, {encoding.high}], the range of {encoding.name}")
    fits = (F.col("v") >= encoding.low) & (F.col("v") <= encoding.high)
    long = long.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(said).cast("double")))
    return components(long, encoding.make(F.col("v"), d), encoding.is_complex)


def components(long: DataFrame, parts: list[Column], is_complex: bool) -> DataFrame:
    pairs = [p if is_complex else complex_of(p, F.lit(0.0)) for p in parts]
    return long.select("series_id", "t", F.posexplode(F.array(*pairs)).alias("k", "z")).select("series_id", "t", "k", F.col("z.re").alias("re"), F.col("z.im").alias("im"))
