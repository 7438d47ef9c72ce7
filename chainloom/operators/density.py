"""Draws of a value from the density that a one-site state implies.

For a density matrix rho of a site, p(x) = phi(x)* rho phi(x) is a sum of products of basis functions. Where
these are exponentials or polynomials on intervals (``closed_form``), p and its integral are sums
of known functions whose coefficients are linear in rho; so the distribution function of every row is exact, and
it is inverted for all rows at once by bracketed Newton steps. Other encodings are drawn on a
grid, and two-component angle encodings also in the eigenbasis of rho.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from numpy.polynomial import legendre as L
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainloom.functions.encodings import fourier_frequencies
from chainloom.functions.fitted import FittedEncoding


def states_at(spark: SparkSession, e: FittedEncoding, points: np.ndarray, label: int = 0) -> np.ndarray:
    """(sites or 1, points, d): states of ``points`` (sites or 1, points) by the expressions that data are encoded with."""
    if e.spec.kind == "plain":
        rows = [(0, [float(x) for x in points.ravel()])]
    else:
        rows = [(m, [float(x) for x in points[:, m]]) for m in range(points.shape[1])]
    df = spark.createDataFrame(rows, "m int, x array<double>").withColumn("z", e.column(F.lit(label)))
    found = df.select("m", F.col("z.re").alias("re"), F.col("z.im").alias("im")).orderBy("m").collect()
    z = np.array([np.array(r.re) + 1j * np.array(r.im) for r in found])
    if e.spec.kind == "plain":
        return z.reshape(*points.shape, e.d)
    return z.reshape(points.shape[1], points.shape[0], e.d).transpose(1, 0, 2)


@dataclass(frozen=True)
class Piece:
    """Basis functions on [low, high]: exponentials of the frequencies, or polynomials of degree d - 1."""

    low: float
    high: float
    frequencies: np.ndarray | None  # None: polynomials, as Legendre series of the interval
    coefficients: np.ndarray  # (d, terms): what each component of phi is of the terms

    def terms(self, x: np.ndarray) -> np.ndarray:
        if self.frequencies is None:
            return L.legvander(self._inner(x), self.coefficients.shape[1] - 1)
        return np.exp(1j * np.multiply.outer(x - self.low, self.frequencies))

    def _inner(self, x: np.ndarray) -> np.ndarray:
        return (2 * x - self.low - self.high) / (self.high - self.low)

    def phi(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x) @ self.coefficients.T

    @cached_property
    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, (terms, d, d)): p(x) is the sum over numbers k of sum(rho * T[k]) times the k-th function."""
        c = self.coefficients
        if self.frequencies is None:
            d, n = c.shape
            t = np.zeros((2 * n - 1, d, d), complex)
            for s in range(d):
                for u in range(d):
                    made = L.legmul(c[s].conj(), c[u])
                    t[: len(made), s, u] = made
            return np.arange(2 * n - 1), t
        gaps = np.round(np.subtract.outer(self.frequencies, self.frequencies), 9).T  # [m, m']: f_m' - f_m
        numbers = np.unique(gaps)
        return numbers, np.array([np.einsum("sm,tn,mn->st", c.conj(), c, gaps == g) for g in numbers])

    def weights(self, rho: np.ndarray) -> np.ndarray:
        """(rows, terms) of densities (rows, d, d)."""
        return np.einsum("nst,kst->nk", rho, self.products[1], optimize=True)

    def density(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        numbers = self.products[0]
        f = L.legvander(self._inner(x), len(numbers) - 1) if self.frequencies is None else np.exp(1j * np.multiply.outer(x - self.low, numbers))
        return (weights * f).sum(axis=1).real

    def integral(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of the density from ``low`` to x, one x for each row."""
        numbers = self.products[0]
        if self.frequencies is None:
            v = L.legvander(self._inner(x), len(numbers))
            f = np.empty((len(x), len(numbers)))
            f[:, 0] = v[:, 1] + 1
            k = np.arange(1, len(numbers))
            f[:, 1:] = (v[:, 2:] - v[:, :-2]) / (2 * k + 1)
            f *= (self.high - self.low) / 2
        else:
            z, i = np.multiply.outer(x - self.low, numbers), np.where(numbers == 0, 1, numbers)
            f = np.where(numbers == 0, (x - self.low)[:, None], np.expm1(1j * z) / (1j * i))
        return (weights * f).sum(axis=1).real


class Exact:
    """Draws by the inverse of the distribution function. ``pieces`` lie side by side."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces

    def cdf(self, rho: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The share of the density below x, row by row."""
        upto, total = np.zeros(len(x)), np.zeros(len(x))
        for p in self.pieces:
            w = p.weights(rho)
            total += p.integral(w, np.full(len(x), p.high))
            upto += p.integral(w, np.clip(x, p.low, p.high))
        return upto / total

    def draw(self, rho: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, their states) at the places u of the distributions; an even one where rho is 0."""
        weights = [p.weights(rho) for p in self.pieces]
        shares = np.stack([np.maximum(p.integral(w, np.full(len(u), p.high)), 0) for p, w in zip(self.pieces, weights)], axis=1)
        empty = shares.sum(axis=1) <= 0
        shares[empty] = [p.high - p.low for p in self.pieces]
        upto = np.cumsum(shares, axis=1)
        goal = u * upto[:, -1]
        at = np.minimum((upto <= goal[:, None]).sum(axis=1), len(self.pieces) - 1)
        x, phi = np.zeros(len(u)), np.zeros((len(u), rho.shape[1]), complex)
        for k, p in enumerate(self.pieces):
            rows = np.flatnonzero(at == k)
            if len(rows):
                left = goal[rows] - (upto[rows, k] - shares[rows, k])
                x[rows] = np.where(empty[rows], p.low + left, _solved(p, weights[k][rows], left, shares[rows, k]))
                phi[rows] = p.phi(x[rows])
        return x, phi


def _solved(p: Piece, weights: np.ndarray, goal: np.ndarray, share: np.ndarray) -> np.ndarray:
    """x with integral(x) = goal: Newton steps within a bracket that halves whenever one leaves it or slows down."""
    a, b = np.full(len(goal), p.low), np.full(len(goal), p.high)
    x = a + (b - a) * np.clip(goal / np.maximum(share, 1e-300), 0, 1)
    before = np.full(len(goal), np.inf)
    for _ in range(200):
        f = p.integral(weights, x) - goal
        a, b = np.where(f <= 0, x, a), np.where(f > 0, x, b)
        done = (np.abs(f) <= 1e-14 * share) | (b - a <= 4e-16 * max(abs(p.low), abs(p.high)))
        if done.all():
            break
        slope = p.density(weights, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - f / slope
        poor = ~((step > a) & (step < b)) | (np.abs(f) > before / 2)
        before = np.abs(f)
        x = np.where(done, x, np.where(poor, (a + b) / 2, step))
    return x


class Grid:
    """Draws by the distribution function on a grid, linear between its points; the state of the nearer point."""

    def __init__(self, grid: np.ndarray, phi: np.ndarray):
        self.grid, self.phi = grid, phi

    def draw(self, rho: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grid, phi = self.grid, self.phi
        p = np.maximum(np.einsum("gs,nst,gt->ng", phi.conj(), rho, phi, optimize=True).real, 0)
        area = np.cumsum((p[:, 1:] + p[:, :-1]) / 2 * np.diff(grid), axis=1)
        total = area[:, -1:]
        area = np.where(total > 0, area / np.where(total > 0, total, 1), np.linspace(0, 1, len(grid))[1:])
        k = np.minimum((area < u[:, None]).sum(axis=1), len(grid) - 2)
        rows = np.arange(len(u))
        low = np.where(k > 0, area[rows, np.maximum(k - 1, 0)], 0.0)
        part = np.clip((u - low) / np.maximum(area[rows, k] - low, 1e-300), 0, 1)
        return grid[k] + part * (grid[k + 1] - grid[k]), phi[np.where(part < 0.5, k, k + 1)]


class Categorical:
    """Draws one of the grid's points, by their shares of the density."""

    def __init__(self, grid: np.ndarray, phi: np.ndarray):
        self.grid, self.phi = grid, phi

    def draw(self, rho: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.maximum(np.einsum("gs,nst,gt->ng", self.phi.conj(), rho, self.phi, optimize=True).real, 0)
        total = p.sum(axis=1, keepdims=True)
        upto = np.cumsum(np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1]), axis=1)
        k = np.minimum((upto <= u[:, None]).sum(axis=1), p.shape[1] - 1)
        return self.grid[k], self.phi[k]


class Eigen:
    """Draws an eigenstate of rho by its eigenvalue; the value is the one whose angle the first component has."""

    def draw(self, rho: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eigh(rho)
        p = np.maximum(values, 0)
        total = p.sum(axis=1, keepdims=True)
        upto = np.cumsum(np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1]), axis=1)
        k = np.minimum((upto <= u[:, None]).sum(axis=1), p.shape[1] - 1)
        v = vectors[np.arange(len(u)), :, k]
        return 2 / np.pi * np.arccos(np.minimum(np.abs(v[:, 0]), 1)), v


def intervals(e: FittedEncoding, numbers: tuple[float, ...]) -> list[tuple[float, float, np.ndarray | None, int]]:
    """(low, high, frequencies, terms) of the pieces on which the components are exponentials or polynomials."""
    inner, d = e.spec.inner, e.inner_d
    if e.spec.kind == "projected":
        ks = np.array(numbers)
        return [(e.low, e.high, np.pi * ks, len(ks))] if inner == "fourier" else [(e.low, e.high, None, int(ks.max()) + 1)]
    angle = np.pi * np.array([-2.0, -1.0, 1.0, 2.0])
    known = {
        "stoudenmire": [(e.low, e.high, angle, 4)],
        "half_angle": [(e.low, e.high, np.pi / 2 * np.array([-1.0, 1.0]), 2)],
        "fourier": [(e.low, e.high, np.pi * np.array(fourier_frequencies(d), float), d)],
        "sahand": [(k * 2 / d, (k + 1) * 2 / d, angle * d / 2, 4) for k in range(d // 2)],
        "uniform": [(e.low, e.high, np.zeros(1), 1)],
        "legendre": [(e.low, e.high, None, d)],
        "legendre_no_norm": [(e.low, e.high, None, d)],
    }.get(inner)
    if known is None:
        raise ValueError(f"{inner} has no closed form here; draw on a grid")
    if e.spec.kind == "plain":
        return known
    found = []
    for a, b in zip(numbers, numbers[1:]):  # the place within a bin, from 0 to 1, is what the inner encoding gets
        for low, high, f, n in known:
            low, high = max(low, 0.0), min(high, 1.0)
            if b > a and high > low:
                found.append((a + low * (b - a), a + high * (b - a), None if f is None else f / (b - a), n))
    return found


def closed_forms(spark: SparkSession, e: FittedEncoding, label: int = 0) -> list[Exact]:
    """For each site (or for all) the closed form; coefficients are solved for from the encoded states themselves."""
    lists = [()] if e.spec.kind == "plain" else list(e.lists[label if e.by_class else 0])
    spans = [intervals(e, numbers) for numbers in lists]
    m = 6 * max(n for s in spans for *_, n in s) + 8
    most = max(map(len, spans))
    inside = (np.arange(m) + 0.5) / m
    points = np.array([[low + (high - low) * x for low, high, *_ in (s + [s[-1]] * (most - len(s))) for x in inside] for s in spans])
    z, found = states_at(spark, e, points, label).reshape(len(spans), most, m, e.d), []
    for t, s in enumerate(spans):
        pieces = []
        for k, (low, high, f, n) in enumerate(s):
            blank = Piece(low, high, f, np.zeros((e.d, n), complex))
            terms = blank.terms(points[t].reshape(most, m)[k])
            c = np.linalg.lstsq(terms, z[t, k], rcond=None)[0]
            if np.abs(terms @ c - z[t, k]).max() > 1e-9 * max(1.0, np.abs(z[t, k]).max()):
                raise ArithmeticError(f"{e.name} isn't what its closed form says")
            pieces.append(Piece(low, high, f, c.T))
        found.append(Exact(pieces))
    return found


def samplers(spark: SparkSession, e: FittedEncoding, method: str = "grid", points: int = 200, label: int = 0) -> list:
    """One for each site, or one for all: ``exact``, ``grid``, ``categorical`` or ``eigen``."""
    if method == "exact":
        return closed_forms(spark, e, label)
    if method == "eigen":
        if e.name not in ("half_angle", "stoudenmire"):
            raise ValueError(f"the eigenstates of {e.name} have no angle")
        return [Eigen()]
    if method not in ("grid", "categorical"):
        raise ValueError(f"unknown method {method}")
    step = (e.high - e.low) / (points - 1)
    grid = np.minimum(e.low + np.arange(points) * step, e.high)
    sites = 1 if e.spec.kind == "plain" else e.length
    phi = states_at(spark, e, np.tile(grid, (sites, 1)), label)
    return [(Grid if method == "grid" else Categorical)(grid, p) for p in phi]
