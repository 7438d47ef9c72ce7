"""Matrix product states: the model itself, which is small and lives on the driver.

A chain has one tensor (left, local, right) for each site; the centre site has the class
index as a fourth axis. What goes over data (scores, gradients, samples) is in
``training``, ``prediction`` and ``sampling`` as Spark jobs with the chain broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chainloom.functions.fitted import FittedEncoding, parsed

#: Rows of tensor entries, and rows of the encoding (its name, dimensions and the list of a site, of class c or all).
MODEL_SCHEMA = "model_id string, centre int, site int, l int, s int, r int, c int, re double, im double, encoding string, d int, inner_d int, numbers array<double>"


@dataclass(frozen=True)
class Chain:
    tensors: tuple
    centre: int
    encoding: FittedEncoding | None = None  # what it was trained on

    @property
    def length(self) -> int:
        return len(self.tensors)

    @property
    def n_classes(self) -> int:
        return self.tensors[self.centre].shape[3]

    def with_sites(self, first: int, *tensors, centre: int) -> Chain:
        new = list(self.tensors)
        new[first : first + len(tensors)] = tensors
        return replace(self, tensors=tuple(new), centre=centre)

    def norm(self) -> float:
        return float(np.sqrt(sum(abs(inner(self.of_class(c), self.of_class(c))) for c in range(self.n_classes))))

    def normalised(self) -> Chain:
        t = self.tensors[self.centre] / self.norm()
        return self.with_sites(self.centre, t, centre=self.centre)

    def of_class(self, c: int) -> list[np.ndarray]:
        """The tensors of one class, without class axis and not normalised."""
        return [t[..., c] if i == self.centre else t for i, t in enumerate(self.tensors)]


def random_chain(length: int, d: int, bond: int, n_classes: int, seed: int, is_complex: bool = True) -> Chain:
    """Gaussian entries, class axis on the last site, left-orthogonal, of norm 1."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(size=shape) + (1j * rng.normal(size=shape) if is_complex else 0)
    tensors = [draw(1 if j == 0 else bond, d, 1 if j == length - 1 else bond) for j in range(length - 1)]
    tensors.append(draw(1 if length == 1 else bond, d, 1, n_classes))
    return Chain(tuple(tensors), length - 1).normalised() if length == 1 else left_orthogonal(tensors).normalised()


def left_orthogonal(tensors: list[np.ndarray]) -> Chain:
    """The chain up to a positive factor, so that long ones stay in range; what is left of the last site is orthonormal."""
    new = list(tensors)
    for j in range(len(new) - 1):
        a, s, b = new[j].shape
        q, r = np.linalg.qr(new[j].reshape(a * s, b))
        new[j] = q.reshape(a, s, -1)
        new[j + 1] = np.tensordot(r / max(np.linalg.norm(r), 1e-300), new[j + 1], 1)
    return Chain(tuple(new), len(new) - 1)


def right_orthogonal(tensors: list[np.ndarray]) -> list[np.ndarray]:
    """Of a chain without class axis, of norm 1: the right parts of every cut are orthonormal."""
    new = list(tensors)
    for j in range(len(new) - 1, 0, -1):
        a, s, b = new[j].shape
        q, r = np.linalg.qr(new[j].reshape(a, s * b).T)
        new[j] = q.T.reshape(-1, s, b)
        new[j - 1] = np.tensordot(new[j - 1], r.T / max(np.linalg.norm(r), 1e-300), 1)
    new[0] = new[0] / np.linalg.norm(new[0])
    return new


def inner(a: list[np.ndarray], b: list[np.ndarray]) -> complex:
    e = np.ones((1, 1))
    for x, y in zip(a, b):
        e = np.einsum("ij,isk,jsl->kl", e, x.conj(), y, optimize=True)
    return complex(e[0, 0])


def merged(chain: Chain, j: int) -> np.ndarray:
    """Sites j and j + 1 as one tensor (left, s, t, right, class); one of them is the centre."""
    a, b = chain.tensors[j], chain.tensors[j + 1]
    return np.einsum("lsmc,mtr->lstrc", a, b) if chain.centre == j else np.einsum("lsm,mtrc->lstrc", a, b)


def split(chain: Chain, j: int, bond: np.ndarray, to_left: bool, max_bond: int, cutoff: float = 1e-10) -> Chain:
    """Puts a merged tensor back as two sites by a truncated SVD; the class axis goes the way of the sweep."""
    l, s, t, r, c = bond.shape
    m = bond.transpose(0, 1, 4, 2, 3).reshape(l * s * c, t * r) if to_left else bond.reshape(l * s, t * r * c)
    u, w, v = np.linalg.svd(m, full_matrices=False)
    weight = np.cumsum(w[::-1] ** 2)[::-1] / max(np.sum(w**2), 1e-300)
    k = max(1, min(max_bond, int(np.sum(weight > cutoff))))
    u, w, v = u[:, :k], w[:k], v[:k]
    if to_left:
        return chain.with_sites(j, (u * w).reshape(l, s, c, k).transpose(0, 1, 3, 2), v.reshape(k, t, r), centre=j)
    return chain.with_sites(j, u.reshape(l, s, k), (w[:, None] * v).reshape(k, t, r, c), centre=j + 1)


def sum_of_products(phi: np.ndarray, labels: list[int], n_classes: int) -> Chain:
    """The sum of product states (series, sites, d), each in its class; a bond index for each series."""
    n, length, d = phi.shape
    tensors = []
    for j in range(length):
        rows, cols = (1 if j == 0 else n), (1 if j == length - 1 else n)
        t = np.zeros((rows, d, cols, n_classes) if j == length - 1 else (rows, d, cols), complex)
        for i in range(n):
            at = (0 if j == 0 else i, slice(None), 0 if j == length - 1 else i)
            if j == length - 1:
                t[(*at, labels[i])] += phi[i, j]
            else:
                t[at] += phi[i, j]
        tensors.append(t)
    return left_orthogonal(tensors).normalised()


def compressed(chain: Chain, max_bond: int, cutoff: float = 1e-10) -> Chain:
    """The chain with bonds of at most ``max_bond``, class axis on the last site again."""
    for j in range(chain.length - 2, -1, -1):
        chain = split(chain, j, merged(chain, j), True, max_bond, cutoff)
    for j in range(chain.length - 1):
        chain = split(chain, j, merged(chain, j), False, max_bond, cutoff)
    return chain.normalised()


def entropy_profile(tensors: list[np.ndarray], base: float = np.e) -> list[float]:
    """Entanglement entropy at each cut of one class state; squared singular values up to 1e-12 are left out."""
    now, found = right_orthogonal(tensors), []
    for j in range(len(now) - 1):
        a, s, b = now[j].shape
        u, w, v = np.linalg.svd(now[j].reshape(a * s, b), full_matrices=False)
        now[j], p = u.reshape(a, s, -1), w**2
        now[j + 1] = np.tensordot(w[:, None] * v, now[j + 1], 1)
        p = p[p > 1e-12]
        found.append(float(-(p * np.log(p)).sum() / np.log(base)) + 0.0)
    return found


def with_operators(tensors: list[np.ndarray], operators: dict[int, np.ndarray]) -> complex:
    """Expectation of a product of one-site operators in a state of any norm."""
    e, n = np.ones((1, 1)), np.ones((1, 1))
    for j, t in enumerate(tensors):
        o = operators.get(j, np.eye(t.shape[1]))
        e = np.einsum("ij,isk,su,jul->kl", e, t.conj(), o, t, optimize=True)
        n = np.einsum("ij,isk,jsl->kl", n, t.conj(), t, optimize=True)
    return complex(e[0, 0] / n[0, 0])


def spin(name: str, d: int) -> np.ndarray:
    """Sz or Sx of spin (d - 1) / 2."""
    m = np.arange((d - 1) / 2, -(d + 1) / 2, -1)[:d]
    if name == "Sz":
        return np.diag(m)
    up = np.sqrt((d - 1) / 2 * ((d - 1) / 2 + 1) - m[1:] * (m[1:] + 1))
    return (np.diag(up, 1) + np.diag(up, -1)) / 2


def two_point(tensors: list[np.ndarray], name: str = "Sz") -> np.ndarray:
    """Connected correlations of all pairs of sites."""
    d, n = tensors[0].shape[1], len(tensors)
    o, now = spin(name, d), right_orthogonal(tensors)  # what is right of a site adds up to the identity
    step = lambda e, t: np.einsum("ij,isk,jsl->kl", e, t.conj(), t, optimize=True)
    put = lambda e, t, o: np.einsum("ij,isk,su,jul->kl", e, t.conj(), o, t, optimize=True)
    left, one, found = np.ones((1, 1), complex), np.zeros(n), np.zeros((n, n))
    for i in range(n):
        one[i], found[i, i] = np.trace(put(left, now[i], o)).real, np.trace(put(left, now[i], o @ o)).real
        e = put(left, now[i], o)
        for j in range(i + 1, n):
            found[i, j] = found[j, i] = np.trace(put(e, now[j], o)).real
            e = step(e, now[j])
        left = step(left, now[i])
    return found - np.outer(one, one)


def subtracted(a: list[np.ndarray], b: list[np.ndarray], factor: complex) -> list[np.ndarray]:
    """The chain of a - factor b, with summed bonds."""
    out, n = [], len(a)
    for j, (x, y) in enumerate(zip(a, b)):
        y = -factor * y if j == 0 else y
        rows, cols = (1 if j == 0 else x.shape[0] + y.shape[0]), (1 if j == n - 1 else x.shape[2] + y.shape[2])
        t = np.zeros((rows, x.shape[1], cols), np.result_type(x, y, factor))
        t[: x.shape[0], :, : x.shape[2]] += x
        t[rows - y.shape[0] :, :, cols - y.shape[2] :] += y
        out.append(t)
    return out


def difference(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """What is left of ``b`` after projecting on ``a``, of norm 1."""
    rest = subtracted(b, a, inner(a, b) / inner(a, a))
    scale = np.sqrt(abs(inner(rest, rest)))
    return [rest[0] / max(scale, 1e-300), *rest[1:]]


def model_table(spark: SparkSession, chain: Chain, model_id: str) -> DataFrame:
    """The entries of a chain that aren't 0, the last entry of each tensor, which holds its shape, and its encoding."""
    rows = []
    for site, t in enumerate(chain.tensors):
        held = t != 0
        held[tuple(n - 1 for n in t.shape)] = True
        for at in np.argwhere(held).tolist():
            l, s, r, c = (*at, None)[:4]
            z = complex(t[tuple(at)])
            rows.append((model_id, chain.centre, site, l, s, r, c, z.real, z.imag, None, None, None, None))
    if e := chain.encoding:
        rows += [(model_id, None, t, None, None, None, c, None, None, e.name, e.d, e.inner_d, numbers) for c, t, numbers in e.rows() or [(None, None, [])]]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def chain_of(table: DataFrame, model_id: str) -> Chain:
    """A model of a model table; models are bounded by their sites, bonds and classes."""
    rows = table.filter(table["model_id"] == model_id).collect()
    if not rows:
        raise ValueError(f"there is no model {model_id}")
    entries, lists = [r for r in rows if r.encoding is None], [r for r in rows if r.encoding is not None]
    tensors = []
    for site in range(max(r.site for r in entries) + 1):
        own = [r for r in entries if r.site == site]
        shape = [1 + max(getattr(r, k) for r in own) for k in "lsr"]
        if own[0].c is not None:
            shape.append(1 + max(r.c for r in own))
        t = np.zeros(shape, complex)
        for r in own:
            t[(r.l, r.s, r.r) if r.c is None else (r.l, r.s, r.r, r.c)] = complex(r.re, r.im)
        tensors.append(t)
    return Chain(tuple(tensors), entries[0].centre, _encoding_of(lists))


def _encoding_of(rows: list) -> FittedEncoding | None:
    if not rows:
        return None
    first, by_class, found = rows[0], rows[0].c is not None, {(r.c or 0, r.site or 0): tuple(r.numbers) for r in rows}
    if first.site is None:
        lists = ((),)
    else:
        n_classes, length = (1 + max(k[i] for k in found) for i in (0, 1))
        lists = tuple(tuple(found[c, t] for t in range(length)) for c in range(n_classes))
    return FittedEncoding(parsed(first.encoding), first.d, first.inner_d, lists, by_class)
