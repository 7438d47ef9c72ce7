"""Draws against dense states, exact inverses, and bootstraps against plain numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import fitted
from chainloom.operators import bootstrap, density, mps, sampling


def area(f, low, high):
    """By 200 nodes, of a smooth function of one number."""
    x, w = np.polynomial.legendre.leggauss(200)
    return (high - low) / 2 * sum(v * f((low + high) / 2 + (high - low) / 2 * y) for y, v in zip(x, w))


@pytest.fixture(scope="module")
def two_classes(spark):
    r = np.random.default_rng(8)
    rows = [(k, k % 2, [float(v) for v in r.random(6)]) for k in range(30)]
    return spark.createDataFrame(rows, "series_id long, label int, x array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def class_states():
    chain = mps.random_chain(6, 2, 3, 2, seed=4)
    return [mps.right_orthogonal(chain.of_class(c)) for c in range(2)]


def dense_of(state):
    a = np.ones((1, 1))
    for t in state:
        a = np.einsum("pl,lsr->psr", a, t).reshape(-1, t.shape[2])
    return a.reshape([2] * len(state))


def half(v):
    return np.array([np.cos(np.pi / 2 * v), np.sin(np.pi / 2 * v)])


def test_one_pass_gives_what_each_class_alone_gives(two_classes, class_states):
    found = sampling.draws(two_classes, class_states, "half_angle", 2, [1, 4], 7)
    got = {(r.series_id, r.t): (r.label, r.xs) for r in found.collect()}
    assert len(got) == 60
    for c in (0, 1):
        own = sampling.draws(two_classes.filter(F.col("label") == c), class_states[c], "half_angle", 2, [1, 4], 7).collect()
        for r in own:
            assert got[r.series_id, r.t][0] == c and got[r.series_id, r.t][1] == pytest.approx(r.xs)
    local = two_classes.sparkSession.createDataFrame(two_classes.collect(), two_classes.schema)
    plan = sampling.draws(local, class_states, "half_angle", 2, [1, 4], 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("MapInArrow") == plan.count("Scan ") == 1
    with pytest.raises(Exception, match="no state"):
        sampling.draws(two_classes.withColumn("label", F.lit(5)), class_states, "half_angle", 2, [1], 2).collect()


@pytest.mark.parametrize("ordered", [False, True])
def test_conditional_densities_are_those_of_the_dense_state(spark, class_states, ordered):
    """The distribution of each draw, given all fixed sites and the draws before it, at the drawn value is u."""
    values, missing, shots = [0.3, None, 0.8, None, 0.1, 0.6], [1, 3], 5
    one = spark.createDataFrame([(4, 0, [v or 0.0 for v in values])], "series_id long, label int, x array<double>")
    found = {r.t: r.xs for r in sampling.draws(one, class_states, "half_angle", 2, missing, shots, seed=2, method="exact", ordered=ordered).collect()}
    from chainloom.sources.generators import uniform_of

    u = {(s, t): spark.range(1).select(uniform_of(2, F.lit(4).cast("long"), F.lit(s), F.lit(t)).alias("u")).first().u for s in range(shots) for t in missing}
    for s in range(shots):
        known = {t: v for t, v in enumerate(values) if v is not None}
        for t in missing:
            psi, gone = dense_of(class_states[0]), 0
            for j in range(6):
                if j in known and not (ordered and j > t):
                    psi = np.tensordot(half(known[j]), psi, (0, j - gone))
                    gone += 1
            axis = t - sum(1 for j in known if j < t and not (ordered and j > t))
            m = np.moveaxis(psi, axis, 0).reshape(2, -1)
            p = lambda x, m=m: np.sum(np.abs(half(x) @ m) ** 2)
            share = area(p, 0, found[t][s]) / area(p, 0, 1)
            assert share == pytest.approx(u[s, t], abs=1e-9)
            known[t] = found[t][s]


@pytest.mark.parametrize("name, d", [("stoudenmire", 2), ("half_angle", 2), ("fourier", 5), ("legendre", 4), ("legendre_no_norm", 3), ("sahand", 4), ("uniform", 2), ("uniform split half_angle", 6), ("hist split fourier", 6), ("projected legendre", 3)])
def test_the_distribution_at_each_draw_is_u(spark, two_classes, name, d):
    spec = fitted.parsed(name)
    e = fitted.ENCODINGS[spec.inner]
    s = two_classes.withColumn("x", F.transform("x", lambda v: F.lit(e.low) + v * (e.high - e.low)))
    made = fitted.fitted(s, name, d)
    r = np.random.default_rng(d)
    for exact in density.closed_forms(spark, made)[:2]:
        a = r.normal(size=(400, d, 3)) + 1j * r.normal(size=(400, d, 3))
        a[0] = 0
        rho, u = a @ a.conj().transpose(0, 2, 1), r.random(400)
        x, phi = exact.draw(rho, u)
        assert ((x >= e.low) & (x <= e.high)).all()
        assert np.abs(exact.cdf(rho[1:], x[1:]) - u[1:]).max() < 1e-9
        if spec.kind == "plain":
            want = density.states_at(spark, made, x[None])[0]
            assert np.abs(phi - want).max() < 1e-8
            p = np.einsum("ns,nst,nt->n", phi.conj(), rho, phi).real
            y = np.linspace(e.low, e.high, 4001)
            grid = density.states_at(spark, made, y[None])[0]
            q = np.einsum("gs,st,gt->g", grid.conj(), rho[5], grid).real
            assert np.trapezoid(np.where(y <= x[5], q, 0), y) / np.trapezoid(q, y) == pytest.approx(u[5], abs=2e-3)
            assert (p >= -1e-9).all()


def test_other_encodings_have_no_closed_form(spark, two_classes, class_states):
    with pytest.raises(ValueError, match="closed form"):
        sampling.draws(two_classes, class_states, "linear", 2, [1], 2, method="exact")
    with pytest.raises(ValueError):
        sampling.draws(two_classes, class_states, "linear", 2, [1], 2, method="eigen")
    xs = sampling.draws(two_classes, class_states, "linear", 2, [1], 3, method="categorical", points=11).first().xs
    assert all(min(abs(x - k / 10) for k in range(11)) < 1e-12 for x in xs)


def test_eigenstates_come_as_often_as_the_dense_state_says(spark, class_states):
    state, shots = class_states[1], 6000
    one = spark.createDataFrame([(1, 1, [0.2, 0.0, 0.0, 0.7, 0.5, 0.9])], "series_id long, label int, x array<double>")
    found = {r.t: r.xs for r in sampling.draws(one, class_states, "half_angle", 2, [1, 2], shots, method="eigen").collect()}
    psi = dense_of(state)
    for j, v in ((5, 0.9), (4, 0.5), (3, 0.7), (0, 0.2)):
        psi = np.tensordot(half(v), psi, (0, j))
    rho = psi @ psi.conj().T
    first, v = np.linalg.eigh(rho / np.trace(rho))
    angle = lambda z: round(float(2 / np.pi * np.arccos(min(abs(z), 1))), 6)
    want = Counter()
    for k in (0, 1):
        rest = v[:, k].conj() @ psi
        second = np.outer(rest, rest.conj())
        values, w = np.linalg.eigh(second / np.trace(second))
        for m in (0, 1):
            want[angle(v[0, k]), angle(w[0, m])] += first[k] * values[m]
    got = Counter((round(a, 6), round(b, 6)) for a, b in zip(found[1], found[2]))
    for key, p in want.items():
        near = sum(n for (a, b), n in got.items() if abs(a - key[0]) < 1e-4 and abs(b - key[1]) < 1e-4)
        assert near / shots == pytest.approx(p, abs=4 * np.sqrt(0.25 / shots))


def test_whole_series_are_drawn_from_a_state(spark):
    state = [np.array([1.0, 0.0]).reshape(1, 2, 1), half(0.5).reshape(1, 2, 1), np.array([0.0, 1.0]).reshape(1, 2, 1)]
    rows = sampling.sampled(spark, state, "half_angle", 2, 400, method="exact").collect()
    mean = [np.mean([r.x for r in rows if r.t == t]) for t in range(3)]
    assert len(rows) == 1200 and mean[0] < 0.4 and mean[1] == pytest.approx(0.5, abs=0.05) and mean[2] > 0.6
    assert sampling.sampled(spark, state, "half_angle", 2, 0).count() == 0


def plain_estimates(x, weights, name):
    out = []
    for w in weights.astype(int):
        y = np.repeat(x, w)
        if name == "mean":
            out.append(y.mean())
        elif name == "histogram_mode":
            counts, edges = np.histogram(y, bins=int(np.ceil(np.sqrt(len(y)))), range=(y.min(), y.max()))
            out.append((edges[counts.argmax()] + edges[counts.argmax() + 1]) / 2)
        else:
            width = max(0.9 * min(x.std(), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2, 1e-3)
            grid = np.linspace(0, 1, 101)
            out.append(grid[np.exp(-0.5 * ((grid[:, None] - y[None]) / width) ** 2).sum(axis=1).argmax()])
    return np.array(out)


@pytest.mark.parametrize("name", list(bootstrap.ESTIMATORS))
def test_bootstraps_equal_plain_resampling(spark, name):
    r = np.random.default_rng(6)
    rows = [(k, t, [float(v) for v in r.beta(2 + t, 3, 37 if k else 12)]) for k in range(3) for t in range(2)]
    df = spark.createDataFrame([*rows, (9, 0, []), (9, 1, [0.4])], "series_id long, t int, xs array<double>")
    got = {(g.series_id, g.t): g for g in bootstrap.bootstrapped(df, name, 60, seed=3).collect()}
    for k, t, xs in rows:
        weights = bootstrap.resample_weights(len(xs), 60, 3)
        assert (weights.sum(axis=1) == len(xs)).all()
        want = plain_estimates(np.array(xs), weights, name)
        assert got[k, t].estimate == pytest.approx(want.mean(), rel=1e-9) and got[k, t].error == pytest.approx(want.std(ddof=1), rel=1e-9)
        assert got[k, t].ci == pytest.approx(2.576 * got[k, t].error / np.sqrt(60))
    assert got[9, 0].estimate is None and got[9, 1].error == pytest.approx(0)


def test_resample_weights_are_even(spark):
    w = bootstrap.resample_weights(20, 4000, 1)
    assert np.abs(w.mean(axis=0) - 1).max() < 0.08 and w.var() == pytest.approx(0.95, abs=0.05)
    own = bootstrap.bootstrapped(spark.createDataFrame([(1, 0, [0.2, 0.4])], "series_id long, t int, xs array<double>"), lambda x, w: (w * x).max(axis=1), 10).first()
    assert own.estimate > 0


def test_bias_of_encodings(spark, two_classes):
    """Against adaptive quadrature of the density that a known state implies."""
    for name, d in (("half_angle", 2), ("stoudenmire", 2), ("uniform split half_angle", 4)):
        e = fitted.fitted(two_classes, name, d)
        rows = sampling.encoding_bias(two_classes, e).filter("series_id < 2").collect()
        for r in rows[:4]:
            own = density.states_at(spark, e, np.full((1 if e.spec.kind == "plain" else 6, 1), r.x))[0, 0]
            p = lambda y, t=r.t: np.abs(density.states_at(spark, e, np.full((1 if e.spec.kind == "plain" else 6, len(y)), y))[0] @ own.conj()) ** 2
            y = np.linspace(0, 1, 20001)
            q = p(y)
            assert r.mean == pytest.approx(np.trapezoid(q * y, y) / np.trapezoid(q, y), abs=2e-4)
    binned = sampling.bias_by_bin(sampling.encoding_bias(two_classes, "half_angle", 2), 0.0, 1.0, 4).collect()
    assert sum(r.n for r in binned) == 180 and all(abs(r.bias) <= r["size"] + 1e-12 for r in binned)


def test_mean_trajectories_need_no_shuffle(two_classes, class_states):
    found = sampling.draws(two_classes, class_states, "half_angle", 2, [5], 9)
    for r in sampling.trajectory(found).join(found.select("series_id", "t", "xs"), ["series_id", "t"]).collect():
        assert r["mean"] == pytest.approx(np.mean(r.xs)) and r.deviation == pytest.approx(np.std(r.xs, ddof=1)) and r.n == 9
