"""Encodings that are fitted: names, edges, training, prediction and the model table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import encodings, fitted
from chainloom.operators import mps, prediction, training


@pytest.fixture(scope="module")
def unequal(spark):
    """Series of 5 values in [0, 1], 30 of class 0 with small values and 10 of class 1 with large ones."""
    r = np.random.default_rng(11)
    rows = [(k, int(k >= 30), [float(v) for v in (r.beta(2, 5, 5) if k < 30 else r.beta(5, 2, 5))]) for k in range(40)]
    return spark.createDataFrame(rows, "series_id long, label int, x array<double>").repartition(3).cache()


def test_names():
    assert fitted.parsed("Hist Split Balanced Fourier") == fitted.Spec("histogram", "fourier", True)
    assert fitted.parsed("unif split half_angle") == fitted.parsed("Uniform_Split Half Angle") == fitted.Spec("uniform", "half_angle")
    assert fitted.parsed("legendre no norm").inner == "legendre_no_norm" and fitted.parsed("Fourier projected").kind == "projected"
    for name in ("hist split balanced half_angle", "uniform split fourier", "projected legendre", "sahand"):
        assert fitted.parsed(fitted.parsed(name).name) == fitted.parsed(name)
    for bad in ("", "hist split", "split fourier", "projected half_angle", "balanced fourier"):
        with pytest.raises(ValueError):
            fitted.parsed(bad)


def plain_edges(values, weights, n_bins, low=0.0, high=1.0):
    """Edges over as many copies of each value as it weighs, by a sum over sorted values."""
    order = np.argsort(values)
    v, upto = np.array(values)[order], np.cumsum(np.array(weights)[order])
    n = int(upto[-1])
    step = max(int(np.round(n / n_bins)), 1)
    at = lambda r: v[np.searchsorted(upto, r, "right")]
    inner = [(at(k * step - 1) + at(k * step)) / 2 for k in range(1, n_bins) if k * step < n]
    return [low, *inner, *[high] * (n_bins - len(inner))]


def test_balanced_edges_give_each_class_the_same_weight(unequal):
    rows = unequal.collect()
    e = fitted.fitted(unequal, "hist split balanced half_angle", 8)
    for t in range(5):
        want = plain_edges([r.x[t] for r in rows], [fitted.SAMPLED // (10 if r.label else 30) for r in rows], 4)
        assert e.lists[0][t] == pytest.approx(want)
        middle = want[2]
        shares = [np.mean([r.x[t] < middle for r in rows if r.label == c]) for c in (0, 1)]
        assert sum(shares) == pytest.approx(1, abs=0.15)  # half of the weight lies below
    plain = fitted.fitted(unequal, "hist split half_angle", 8)
    assert plain.lists[0][0] == pytest.approx(plain_edges([r.x[0] for r in rows], [1] * 40, 4))
    own = fitted.fitted(unequal, "hist split half_angle", 8, by_class=True)
    for c in (0, 1):
        assert own.lists[c][3] == pytest.approx(plain_edges([r.x[3] for r in rows if r.label == c], [1] * (10 if c else 30), 4))


def phi_of(v, edges):
    """Components of a value by plain Python: two half-angle ones for each bin."""
    out = []
    for a, b in zip(edges, edges[1:]):
        u = (v - a) / (b - a) if b > a else 0.0
        w = 0.5 if abs(u - 0.5) == 0.5 else float(abs(u - 0.5) < 0.5)
        out += [w * np.cos(np.pi / 2 * u), w * np.sin(np.pi / 2 * u)] if b > a else [0.0, 0.0]
    return np.array(out)


def dense_weight(chain, states, c):
    a = np.ones((1,), complex)
    for t, p in zip(chain.of_class(c), states):
        a = np.einsum("l,s,lsr->r", a, p, t)
    return abs(a[0]) ** 2


@pytest.mark.parametrize("name, by_class", [("hist split balanced half_angle", False), ("hist split half_angle", True), ("uniform split half_angle", False)])
def test_training_and_scores_agree_with_a_dense_contraction(spark, unequal, name, by_class):
    options = training.Options(encoding=name, d=4, encode_by_class=by_class, sweeps=1, max_bond=3, first_bond=2, rate=0.2)
    chain, log = training.fit(unequal, unequal, options)
    assert log[-1]["train_kld"] < log[0]["train_kld"] and log[-1]["test_accuracy"] == log[-1]["train_accuracy"]
    e, weights, kld = chain.encoding, {r.series_id: r.weight for r in prediction.scores(unequal, chain).collect()}, []
    for r in unequal.collect():
        for c in (0, 1):
            lists = e.lists[c if by_class else 0]
            want = dense_weight(chain, [phi_of(v, lists[t]) for t, v in enumerate(r.x)], c)
            assert weights[r.series_id][c] == pytest.approx(want, rel=1e-9, abs=1e-12)
        kld.append(-np.log(weights[r.series_id][r.label]))
    assert log[-1]["train_kld"] == pytest.approx(np.mean(kld), rel=1e-6)
    again = mps.chain_of(mps.model_table(spark, chain, "m"), "m")
    assert again.encoding == e
    for r in prediction.scores(unequal, again).collect():
        assert r.weight == pytest.approx(weights[r.series_id])


def test_projected_and_plain_encodings_go_with_the_model(spark, unequal):
    s = unequal.withColumn("x", F.transform("x", lambda v: 2 * v - 1))
    e = fitted.fitted(s, "projected fourier", 3)
    assert e.length == 5 and all(len(ks) == 3 and 0.0 in ks for ks in e.lists[0])
    first = s.orderBy("series_id").first()
    got = prediction.states(s.filter("series_id = 0"), e, None, "series_id").first()
    want = [np.exp(1j * np.pi * k * v) / np.sqrt(3) for v, ks in zip(first.x, e.lists[0]) for k in ks]
    assert np.array(got.re) + 1j * np.array(got.im) == pytest.approx(np.array(want))
    chain, _ = training.fit(s, None, training.Options(encoding="projected legendre", d=2, sweeps=1, first_bond=2, max_bond=2))
    assert mps.chain_of(mps.model_table(spark, chain, "m"), "m").encoding == chain.encoding
    plain, _ = training.fit(unequal, None, training.Options(sweeps=1, first_bond=2, max_bond=2))
    again = mps.chain_of(mps.model_table(spark, plain, "m"), "m")
    assert again.encoding.name == "stoudenmire"
    assert prediction.scores(unequal, again).orderBy("series_id").collect() == prediction.scores(unequal, plain, "stoudenmire", 2).orderBy("series_id").collect()


def test_what_doesn_t_fit_is_refused(spark, unequal):
    with pytest.raises(ValueError):
        fitted.fitted(unequal, "hist split half_angle", 5)
    with pytest.raises(ValueError):
        fitted.fitted(unequal.limit(0), "hist split half_angle", 4)
    with pytest.raises(ValueError):
        prediction.states(unequal, "hist split half_angle", 4)
    e = fitted.fitted(unequal, "hist split half_angle", 4)
    longer = unequal.withColumn("x", F.concat("x", "x"))
    with pytest.raises(Exception, match="length"):
        prediction.states(longer, e, None, "series_id").collect()
    with pytest.raises(Exception, match="outside"):
        prediction.states(unequal.withColumn("x", F.transform("x", lambda v: v + 1)), e, None, "series_id").collect()
    assert not encodings.ENCODINGS["half_angle"].dimensions(4)


def test_grids_take_composite_encodings(spark, unequal, tmp_path):
    from chainloom.operators import search

    cells = search.grid(spark, 2, [0.1], [2, 3, 4], [2], ["hist split half_angle", "half_angle", "uniform split qudit"])
    assert sorted((r.d, r.encoding) for r in cells.filter("fold = 1").collect()) == [(2, "half_angle"), (2, "hist split half_angle"), (4, "hist split half_angle")]
    options = training.Options(sweeps=1, first_bond=2)
    found = search.run_grid(unequal, cells.filter("fold = 1 AND d = 4"), str(tmp_path / "r"), 2, options)
    assert found.filter("error IS NULL AND test_kld IS NOT NULL").count() == 3
