"""Analyses of class states against series, and of kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.encodings import ENCODINGS, c_abs2, complex_of
from chainloom.functions.fitted import resolved
from chainloom.operators.density import states_at
from chainloom.operators.mps import entropy_profile
from chainloom.operators.prediction import as_states, states


MOST_LANDMARKS = 512


def site_densities(tensors: list[np.ndarray]) -> list[np.ndarray]:
    """The reduced density of each site, of trace 1."""
    right = [np.ones((1, 1), complex)]
    for a in reversed(tensors[1:]):
        right.append(np.einsum("lsr,rq,ksq->lk", a, right[-1], a.conj()))
    right.reverse()
    left, found = np.ones((1, 1), complex), []
    for j, a in enumerate(tensors):
        rho = np.einsum("lk,lsr,rq,kuq->su", left, a, right[j], a.conj())
        found.append(rho / np.trace(rho))
        left = np.einsum("lk,lsr,ksq->rq", left, a, a.conj())
    return found


def site_overlaps(series: DataFrame, tensors: list[np.ndarray], encoding: str, d: int) -> DataFrame:
    """(series_id, t, overlap): overlap of each value's state with its site, the other sites traced out."""
    sent = series.sparkSession.sparkContext.broadcast(np.array(site_densities(tensors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho = sent.value
        for b in batches:
            phi = as_states(b.column(1), b.column(2), len(rho), d)
            o = np.einsum("njs,jsu,nju->nj", phi.conj(), rho, phi, optimize=True).real
            ids = np.repeat(b.column(0).to_numpy(), len(rho))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(len(rho), dtype=np.int32), len(phi))), pa.array(o.ravel())], names=["series_id", "t", "overlap"])

    return states(series, encoding, d, "series_id").mapInArrow(run, "series_id long, t int, overlap double")


def effective_overlaps(series: DataFrame, class_states: list, encoding: str, d: int) -> DataFrame:
    """(series_id, class, overlap): the mean of a series' one-site overlaps with the state of every class, in one pass."""
    e = resolved(encoding, d)
    sent = series.sparkSession.sparkContext.broadcast(np.array([site_densities(t) for t in class_states]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho = sent.value
        n, length = rho.shape[:2]
        for b in batches:
            phi = as_states(b.column(1), b.column(2), length, e.d)
            o = np.stack([np.einsum("njs,jsu,nju->n", phi.conj(), own, phi, optimize=True).real / length for own in rho], axis=1)
            ids = pa.array(np.repeat(np.arange(len(phi)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ids), pa.array(np.tile(np.arange(n, dtype=np.int32), len(phi))), pa.array(o.ravel())], names=["series_id", "class", "overlap"])

    return states(series, e, None, "series_id").mapInArrow(run, "series_id long, class int, overlap double")


def _root(g: np.ndarray) -> np.ndarray:
    """C with C C* = g, for g >= 0; columns of a share of up to 1e-30 are left out."""
    values, vectors = np.linalg.eigh(g)
    held = values > 1e-30 * max(values.max(), 1e-300)
    return vectors[:, held] * np.sqrt(values[held])


def cut_forms(tensors: list[np.ndarray], t: int, grams: tuple[list, list]) -> list[np.ndarray]:
    """For each size b of a cut (cuts, d * d, b * b): once site t is measured in p, the squared singular values of a cut
    are in proportion to the eigenvalues of the b x b sum over u, v of p[u] p*[v] times its form. A cut's form is the
    Gram matrix of the side that holds t between the roots of the one of the other side."""
    left, right = grams
    a, found = tensors[t], {}

    def add(g, other):
        c = _root(other)
        h = np.einsum("lx,uvlk,ky->uvxy", c.conj(), g, c, optimize=True)
        found.setdefault(c.shape[1], []).append(h.reshape(a.shape[1] ** 2, -1))

    g = np.einsum("lur,lk,kvq->uvrq", a.conj(), left[t], a, optimize=True)
    for j in range(t, len(tensors) - 1):
        add(g, right[j].T)
        g = np.einsum("lsr,uvlk,ksq->uvrq", tensors[j + 1].conj(), g, tensors[j + 1], optimize=True)
        g = g / max(np.abs(g).max(), 1e-300)
    g = np.einsum("lur,rq,kvq->uvlk", a.conj(), right[t], a, optimize=True)
    for j in range(t - 1, -1, -1):
        add(g, left[j + 1].T)
        g = np.einsum("lsr,uvrq,ksq->uvlk", tensors[j].conj(), g, tensors[j], optimize=True)
        g = g / max(np.abs(g).max(), 1e-300)
    return [np.array(h) for h in found.values()]


def measured_entropies(forms: list[np.ndarray], p: np.ndarray, rows: int = 512) -> np.ndarray:
    """(rows,): the mean cut entropy after a site, of which ``cut_forms`` are given, is measured in each of the states ``p`` (rows, d)."""
    total, n_cuts = np.zeros(len(p)), sum(map(len, forms))
    for at in range(0, len(p), rows):
        own = p[at : at + rows]
        q = (own[:, :, None] * own.conj()[:, None, :]).reshape(len(own), -1)
        for h in forms:
            b = round(h.shape[2] ** 0.5)
            if b < 2:  # a cut with nothing entangled
                continue
            w = np.maximum(np.linalg.eigvalsh(np.tensordot(q, h, (1, 1)).reshape(-1, b, b)), 0)
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
            total[at : at + rows] -= np.where(w > 1e-12, w * np.log(np.maximum(w, 1e-300)), 0).sum(axis=1).reshape(len(own), -1).sum(axis=1)
    return total / max(n_cuts, 1)


def side_grams(tensors: list[np.ndarray]) -> tuple[list, list]:
    """Gram matrices, of trace 1, of what is left and what is right of each site."""
    left, right = [np.ones((1, 1), complex)], [np.ones((1, 1), complex)]
    for a in tensors[:-1]:
        g = np.einsum("lsr,lk,ksq->rq", a.conj(), left[-1], a)
        left.append(g / abs(np.trace(g)))
    for a in reversed(tensors[1:]):
        g = np.einsum("lsr,rq,ksq->lk", a.conj(), right[-1], a)
        right.append(g / abs(np.trace(g)))
    return left, right[::-1]


#: Series from which on entropies are read from pieces; nodes of a piece, first pieces, halvings, and what a piece may be off by.
PIECES_FROM, NODES, FIRST, HALVINGS, TOLERANCE = 1024, 16, 4, 6, 1e-10


def _chebyshev(x: np.ndarray) -> np.ndarray:
    """(points, NODES): Chebyshev polynomials on [-1, 1]."""
    return np.polynomial.chebyshev.chebvander(x, NODES - 1)


def _piece_points() -> tuple[np.ndarray, np.ndarray]:
    """Places within [-1, 1] of a piece where it is fitted, and where it is checked, between those and at its ends."""
    at = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    return at, np.concatenate([[-1.0], (at[1:] + at[:-1]) / 2, [1.0]])


def entropy_pieces(value_of, low: float, high: float, halvings: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, coefficients (pieces, NODES)) of a function of one value: pieces of Chebyshev polynomials that are halved until they are
    right within ``TOLERANCE`` where they are checked. Coefficients are NaN where a piece still isn't after
    ``halvings``: there the function itself is to be taken. ``value_of(level, k)``: the values at the points of the k-th piece of a level."""
    at, between = _piece_points()
    fit, check, found = np.linalg.inv(_chebyshev(at)), _chebyshev(between), []

    def add(level, k):
        values = value_of(level, k)
        c = fit @ values[:NODES]
        if np.abs(check @ c - values[NODES:]).max() <= TOLERANCE:
            found.append((k / (FIRST << level), c))
        elif level == halvings:
            found.append((k / (FIRST << level), np.full(NODES, np.nan)))
        else:
            add(level + 1, 2 * k)
            add(level + 1, 2 * k + 1)

    for k in range(FIRST):
        add(0, k)
    edges = low + (high - low) * np.array([f[0] for f in found] + [1.0])
    return edges, np.array([f[1] for f in found])


def _entropy_tables(spark, each: list, e) -> dict:
    """{(class, site): (edges, coefficients)} of the mean cut entropy after the site is measured in the state of a value; a row of
    the job is a class and site, so its work doesn't grow with the series."""
    at, halvings = np.concatenate(_piece_points()), HALVINGS
    places = [(level, k) for level in range(halvings + 1) for k in range(FIRST << level)]
    points = np.array([e.low + (e.high - e.low) * (k + (at + 1) / 2) / (FIRST << level) for level, k in places])
    phi = states_at(spark, e, np.clip(points.reshape(1, -1), e.low, e.high))[0].reshape(len(places), len(at), e.d)
    sent = spark.sparkContext.broadcast((each, dict(zip(places, phi))))

    def table(key):
        states, phi = sent.value
        forms = cut_forms(states[key[0]][0], key[1], states[key[0]][2])
        return key, entropy_pieces(lambda level, k: measured_entropies(forms, phi[level, k]), e.low, e.high, halvings)

    keys = [(c, t) for c, (tensors, *_) in enumerate(each) for t in range(len(tensors))]
    return dict(spark.sparkContext.parallelize(keys, min(len(keys), 4 * spark.sparkContext.defaultParallelism)).map(table).collect())


def read_pieces(pieces: tuple[np.ndarray, np.ndarray], v: np.ndarray) -> np.ndarray:
    edges, coefficients = pieces
    k = np.clip(np.searchsorted(edges, v, side="right") - 1, 0, len(coefficients) - 1)
    x = (2 * v - edges[k] - edges[k + 1]) / (edges[k + 1] - edges[k])
    return (_chebyshev(x) * coefficients[k]).sum(axis=1)


def entropy_variations(series: DataFrame, class_states: list, encoding: str, d: int) -> DataFrame:
    """(series_id, label, t, variation): the mean change of the cut entropies after site t of the state of the
    series' class (or of the one state given) is measured in the state of the series' value.

    A site's entropy is a function of one value, unless the encoding is fitted. From ``PIECES_FROM`` series on it is
    computed once, at the points of ``entropy_pieces``, and read from there; values in pieces that don't hold are computed each.
    """
    alone, e, spark = isinstance(class_states[0], np.ndarray), resolved(encoding, d), series.sparkSession
    each = [(t, float(np.mean(entropy_profile(t))), side_grams(t)) for t in ([class_states] if alone else class_states)]
    many = e.spec.kind == "plain" and series.limit(PIECES_FROM).count() == PIECES_FROM
    sent = spark.sparkContext.broadcast((each, _entropy_tables(spark, each, e) if many else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (each, tables), forms = sent.value, {}
        for b in batches:
            label = np.zeros(b.num_rows, int) if alone else b.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(label):
                c = int(c)
                tensors, before, grams = each[c]
                part = b.take(pa.array(np.flatnonzero(label == c)))
                phi = as_states(part.column(2), part.column(3), len(tensors), e.d)
                x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(phi), -1)
                for t in range(len(tensors)):
                    found = read_pieces(tables[c, t], x[:, t]) if tables else np.full(len(phi), np.nan)
                    rest = np.flatnonzero(np.isnan(found))
                    if len(rest):
                        if (c, t) not in forms:
                            forms[c, t] = cut_forms(tensors, t, grams)
                        found[rest] = measured_entropies(forms[c, t], phi[rest, t])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(phi), t, np.int32)), pa.array(found - before)], names=["series_id", "label", "t", "variation"])

    rows = states(series.withColumn("label", F.col("label").cast("int")), e, None, "series_id", "label", "x")
    rows = rows.select("series_id", "label", "re", "im", "x")
    return rows.mapInArrow(run, "series_id long, label int, t int, variation double")


def embedded(similarities: DataFrame, dimensions: int = 2) -> DataFrame:
    """(series_id, axis, x) of every series, from its similarities to landmarks (query_id, series_id, overlap).

    Classical scaling of the landmarks, at most ``MOST_LANDMARKS``, with distances sqrt(2 - 2 |overlap|); every
    series is then placed by its distances to them, which for a landmark is its own place again.
    """
    spark = similarities.sparkSession
    ids = sorted(r.query_id for r in similarities.select("query_id").distinct().limit(MOST_LANDMARKS + 1).collect())
    if len(ids) > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
    at = {i: k for k, i in enumerate(ids)}
    d2 = np.zeros((len(ids), len(ids)))
    for r in similarities.filter(F.col("series_id").isin(ids)).collect():  # landmarks squared
        d2[at[r.query_id], at[r.series_id]] = 2 - 2 * min(1.0, abs(r.overlap))
    centre = np.eye(len(ids)) - 1 / max(len(ids), 1)
    values, vectors = np.linalg.eigh(-centre @ d2 @ centre / 2)
    top = np.argsort(values)[::-1][:dimensions]
    u = vectors[:, top] * np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top] + 1e-300)
    scale = np.where(values[top] > 1e-12, values[top], np.inf) ** -0.5
    weights = [(i, a, float(-u[at[i], a] * scale[a] / 2), float(d2[at[i]].mean())) for i in ids for a in range(len(top))]
    sent = F.broadcast(spark.createDataFrame(weights, "query_id long, axis int, w double, mean double"))
    far = 2.0 - 2.0 * F.least(F.lit(1.0), F.abs("overlap"))
    return similarities.join(sent, "query_id").groupBy("series_id", "axis").agg(F.sum(F.col("w") * (far - F.col("mean"))).alias("x"))


def projected_basis(series: DataFrame, kind: str, d: int, terms: int | None = None, bandwidth: float = 0.8, points: int = 200, bins: int = 512) -> DataFrame:
    """(t, place, term, weight): for each time point the d basis functions of greatest squared
    coefficient of the root of the values' density, best first.

    The density is a Gaussian estimate on a grid of [-1, 1]; values are summed up in ``bins`` bins of
    the range first (each at its mean), so the work doesn't grow with the number of series.
    """
    from chainloom.functions.encodings import fourier_frequencies, legendre_polynomial

    long = series.select(F.posexplode("x").alias("t", "v"))
    counts = long.groupBy("t", F.floor(F.col("v") * (bins / 2)).alias("b")).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    step = 2.0 / (points - 1)
    grid = counts.select("t", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")).withColumn("x", F.lit(-1.0) + F.col("g") * step)
    density = grid.groupBy("t", "g", "x").agg(F.sqrt(F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("m")) / bandwidth, F.lit(2.0)))) / (F.sum("n") * bandwidth * float(np.sqrt(2 * np.pi)))).alias("y"))
    if kind == "fourier":
        numbers = fourier_frequencies(terms or 10 * d)
        parts = [complex_of(F.cos(F.col("x") * (np.pi * k)), -F.sin(F.col("x") * (np.pi * k))) for k in numbers]
    elif kind == "legendre":
        numbers = list(range(terms or 10 * d))
        parts = [complex_of(legendre_polynomial(F.col("x"), n) * float(np.sqrt((2 * n + 1) / 2)), F.lit(0.0)) for n in numbers]
    else:
        raise ValueError(f"no projection onto {kind}; {sorted(ENCODINGS)} are encodings")
    weight = F.when((F.col("g") == 0) | (F.col("g") == points - 1), step / 2).otherwise(step)
    sums = []
    for k, p in zip(numbers, parts):
        sums += [F.sum(F.col("y") * weight * p["re"]).alias(f"re{k}"), F.sum(F.col("y") * weight * p["im"]).alias(f"im{k}")]
    wide = density.groupBy("t").agg(*sums)
    terms_of = F.array(*[F.struct((-c_abs2(complex_of(F.col(f"re{k}"), F.col(f"im{k}")))).alias("w"), F.lit(i).alias("i"), F.lit(k).alias("term")) for i, k in enumerate(numbers)])
    best = wide.select("t", F.posexplode(F.slice(F.array_sort(terms_of), 1, d)).alias("place", "s"))
    return best.select("t", "place", "s.term", (-F.col("s.w")).alias("weight"))
