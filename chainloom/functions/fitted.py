"""Encodings that are fitted on series and go with a model.

A fitted encoding is a composite name (``"hist split balanced fourier"``, ``"uniform split stoudenmire"``,
``"projected legendre"``, or a plain one), a dimension, and for each time point a list of numbers: the
edges of bins, or the numbers of the chosen basis functions. With ``by_class`` each class has lists of
its own. The lists are bounded by classes, sites and bins, so they are sent with the query
as one literal, and encoding stays a column expression without a join.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.encodings import ENCODINGS, Encoding, complex_of, fourier_by_list, histogram_edges, legendre_by_list, split_on_edges

SAMPLED = 1 << 40  # what the series of a class weigh together where classes are balanced


@dataclass(frozen=True)
class Spec:
    """What a name says: how parameters are found, and the encoding within a bin or of the chosen functions."""

    kind: str  # plain, uniform, histogram or projected
    inner: str
    balanced: bool = False

    @property
    def name(self) -> str:
        return {"plain": "", "projected": "projected "}.get(self.kind, f"{self.kind} split {'balanced ' * self.balanced}") + self.inner


def parsed(name: str) -> Spec:
    """``[hist|histogram|unif|uniform] split [balanced] <encoding>``, ``projected <fourier|legendre>``, or
    ``<encoding>``; in any case, with spaces or underscores."""
    words = re.sub(r"[\s_]+", " ", name.strip().lower())
    plain = words.replace(" ", "_")
    if plain in ENCODINGS:
        return Spec("plain", plain)
    if m := re.fullmatch(r"(hist|histogram|unif|uniform) split (balanced )?(.+)", words):
        if (inner := m[3].replace(" ", "_")) in ENCODINGS:
            return Spec("histogram" if m[1].startswith("hist") else "uniform", inner, bool(m[2]))
    if (m := re.fullmatch(r"projected (\w+)|(\w+) projected", words)) and (inner := m[1] or m[2]) in ("fourier", "legendre"):
        return Spec("projected", inner)
    raise ValueError(f"no encoding is named {name!r}; plain ones are {sorted(ENCODINGS)}")


def takes_dimension(name: str, d: int, inner_d: int = 2) -> bool:
    """Whether an encoding of a name, plain or composite, can have d components."""
    spec = parsed(name)
    e = ENCODINGS[spec.inner]
    if spec.kind in ("uniform", "histogram"):
        return d % inner_d == 0 and e.dimensions(inner_d)
    return e.dimensions(d)


@dataclass(frozen=True)
class FittedEncoding:
    """``lists``: for each class (one entry for all, without ``by_class``) and time point the numbers."""

    spec: Spec
    d: int
    inner_d: int
    lists: tuple[tuple[tuple[float, ...], ...], ...]
    by_class: bool = False

    @property
    def name(self) -> str:
        return self.spec.name

    @property
    def plain(self) -> Encoding:
        return ENCODINGS[self.spec.inner]

    @property
    def low(self) -> float:
        return self.plain.low

    @property
    def high(self) -> float:
        return self.plain.high

    @property
    def length(self) -> int:
        return len(self.lists[0])

    def dimensions(self, d: int) -> bool:
        return d == self.d

    def components(self, v: Column, numbers: Column) -> Column:
        """Array of the d complex components of a value, from the list of its place."""
        spec, e = self.spec, self.plain
        if spec.kind == "projected":
            ks = F.transform(numbers, lambda k: k.cast("int"))
            most = int(max((k for by_time in self.lists for ks in by_time for k in ks), default=0))
            return fourier_by_list(v, ks) if spec.inner == "fourier" else legendre_by_list(v, ks, most)
        parts = e.make(v, self.d) if spec.kind == "plain" else split_on_edges(v, numbers, self.d // self.inner_d, e.make, self.inner_d)
        return F.array(*[p if e.is_complex else complex_of(p, F.lit(0.0)) for p in parts])

    def column(self, label: Column | None = None, x: str = "x") -> Column:
        """Flat array of the components of all values of the array ``x``, one value after another.
        ``label``: whose lists are taken, with ``by_class``."""
        if self.spec.kind == "plain":
            return F.flatten(F.transform(x, lambda v: self.components(v, F.lit(None))))
        sent = F.from_json(F.lit(json.dumps(self.lists)), "array<array<array<double>>>")
        own = F.get(sent, label.cast("int")) if self.by_class else sent[0]
        known = F.when(own.isNotNull() & (F.size(own) == F.size(x)), own).otherwise(F.raise_error(F.lit(f"a series has no class or length of the encoding {self.name}")).cast("array<array<double>>"))
        return F.flatten(F.transform(F.arrays_zip(F.col(x).alias("v"), known.alias("p")), lambda s: self.components(s["v"], s["p"])))

    def rows(self) -> list[tuple[int | None, int, list[float]]]:
        """(class, site, numbers) of each list."""
        return [(c if self.by_class else None, t, list(numbers)) for c, by_time in enumerate(self.lists) for t, numbers in enumerate(by_time)]


def class_weights(series: DataFrame) -> DataFrame:
    """Adds ``weight``: about ``SAMPLED`` shared out among the series of each class, whole numbers; for
    classes of up to a million series they differ by less than one in a million."""
    counts = series.groupBy("label").agg(F.expr(f"{SAMPLED} div count(*)").alias("weight"))
    return series.join(counts, series["label"].eqNullSafe(counts["label"])).drop(counts["label"])


def edges_of(series: DataFrame, spec: Spec, n_bins: int, by_class: bool) -> DataFrame:
    """([label,] t, edges) of a histogram split."""
    e = ENCODINGS[spec.inner]
    if spec.balanced and not by_class:  # alone, a class needs no balance
        return histogram_edges(class_weights(series), n_bins, e.low, e.high, weight="weight")
    return histogram_edges(series, n_bins, e.low, e.high, by=("label",) if by_class else ())


def fitted(series: DataFrame, name: str, d: int, inner_d: int = 2, by_class: bool = False) -> FittedEncoding:
    """The encoding of a name, fitted on series (label, x) in its range. ``inner_d``: components within a bin."""
    spec = parsed(name)
    e = ENCODINGS[spec.inner]
    if spec.kind == "plain":
        if not e.dimensions(d):
            raise ValueError(f"{spec.inner} takes no dimension {d}")
        return FittedEncoding(spec, d, d, ((),))
    out = F.exists("x", lambda v: (v < e.low) | (v > e.high))
    shape = series.agg(F.max(F.size("x")).alias("length"), F.max(F.col("label").cast("int")).alias("last"), F.count_if(out).alias("out")).first()
    if shape.length is None:
        raise ValueError("there are no series to fit an encoding on")
    if shape.out:
        raise ValueError(f"{shape.out} series have values outside [{e.low}, {e.high}], the range of {spec.inner}")
    n_classes = shape.last + 1 if by_class else 1
    if spec.kind == "projected":
        from chainloom.operators.analysis import projected_basis

        if by_class:
            raise ValueError("projections are fitted on all classes together")
        found = projected_basis(series, spec.inner, d)
        rows = found.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"].cast("double")).alias("numbers"))
        rows = rows.select(F.lit(0).alias("c"), "t", "numbers")
        inner_d = d
    else:
        if d % inner_d or not e.dimensions(inner_d):
            raise ValueError(f"{spec.inner} bins of {inner_d} components don't make a dimension of {d}")
        n_bins = d // inner_d
        if spec.kind == "uniform":
            one = tuple(e.low + (e.high - e.low) * k / n_bins for k in range(n_bins + 1))
            return FittedEncoding(spec, d, inner_d, ((one,) * shape.length,) * n_classes, by_class)
        label = F.col("label").cast("int") if by_class else F.lit(0)
        rows = edges_of(series, spec, n_bins, by_class).select(label.alias("c"), "t", F.col("edges").alias("numbers"))
    lists = [[()] * shape.length for _ in range(n_classes)]
    for r in rows.collect():  # classes times sites
        lists[r.c][r.t] = tuple(r.numbers)
    return FittedEncoding(spec, d, inner_d, tuple(map(tuple, lists)), by_class)


def resolved(encoding: str | FittedEncoding, d: int | None) -> FittedEncoding:
    """A plain name or a fitted encoding as the latter; other names must be fitted first."""
    if isinstance(encoding, FittedEncoding):
        return encoding
    spec = parsed(encoding)
    if spec.kind != "plain":
        raise ValueError(f"{encoding} must be fitted first")
    if not ENCODINGS[spec.inner].dimensions(d):
        raise ValueError(f"{encoding} takes no dimension {d}")
    return FittedEncoding(spec, d, d, ((),))
