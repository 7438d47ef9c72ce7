"""The queries on chains use every label and every time point."""

import numpy as np
import pytest

from chainloom.operators import analysis, mps
from chainloom.plans import models

LENGTH, CLASSES = 11, 3


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """45 series of 11 values and 3 labels."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=LENGTH)], i % CLASSES) for i in range(45)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def amplitudes(spark, folder):
    out = {}
    for r in models._unit(spark, folder).collect():
        a = np.array([1.0, 0.0])
        for v in r.x:
            a = np.einsum("l,s,lsr->r", a, [np.cos(v * np.pi / 2), np.sin(v * np.pi / 2)], np.array(models.TENSOR))
        out[r.series_id] = (r.label, a)
    return out


def test_scores_of_all_series_and_sites_equal_brute_force(spark, folder, amplitudes):
    want = {(i, c): a[c] for i, (_, a) in amplitudes.items() for c in (0, 1)}
    for name in ("mps_score_hof", "mps_score_coo"):
        got = {(r.series_id, r.c): r.amplitude for r in models.QUERIES[name](spark, folder).collect()}
        assert got == pytest.approx(want, abs=1e-9), name


def test_classes_of_all_series_equal_brute_force(spark, folder, amplitudes):
    turn = np.pi * np.arange(CLASSES) / CLASSES
    weight = {i: (label, (a[0] * np.cos(turn) + a[1] * np.sin(turn)) ** 2) for i, (label, a) in amplitudes.items()}
    want = {i: int(w.argmax()) for i, (_, w) in weight.items()}
    assert {r.series_id: r.predicted for r in models.QUERIES["mps_predict"](spark, folder).collect()} == want
    table = np.zeros((CLASSES, CLASSES), int)
    for i, (label, _) in weight.items():
        table[label, want[i]] += 1
    seen = {c for i, (label, _) in weight.items() for c in (label, want[i])}
    got = {(r.truth, r.predicted): r.n for r in models.QUERIES["mps_confusion"](spark, folder).collect()}
    assert got == {(a, b): table[a, b] for a in seen for b in seen}
    recall = {r["class"]: r.recall for r in models.QUERIES["mps_metrics"](spark, folder).collect()}
    assert recall == pytest.approx({c: table[c, c] / table[c].sum() for c in range(CLASSES)}, abs=1e-6)
    row = models.QUERIES["mps_kld"](spark, folder).first()
    assert row.n == 45 and row.kld == pytest.approx(np.mean([-np.log(w[label]) for label, w in weight.values()]), abs=1e-6)
    stats = {(r.label, r.model): r.median for r in models.QUERIES["mps_overlap_statistics"](spark, folder).collect()}
    assert stats == pytest.approx({(k, c): np.median([np.sqrt(w[c]) for label, w in weight.values() if label == k]) for k in range(CLASSES) for c in range(CLASSES)}, abs=1e-6)


def test_kernels_and_bases_use_all_values(spark, folder):
    x = {r.series_id: np.array(r.x) for r in models._unit(spark, folder).collect()}
    got = {(r.query_id, r.series_id): r.rlf for r in models.QUERIES["rlf_kernel"](spark, folder).collect()}
    assert got == pytest.approx({(q, i): 2 ** np.log10(abs(np.cos(np.pi / 2 * (x[q] - x[i])).prod())) for q in (0, 20, 40) for i in x}, abs=1e-8)
    assert models.QUERIES["basis_projection"](spark, folder).select("t").distinct().count() == LENGTH


def test_training_and_forecasts_use_all_labels_and_sites(spark, folder):
    q = {n: models.QUERIES[n](spark, folder) for n in ("mps_train", "mps_model_table", "mps_forecast", "mps_interpolate", "mps_forecast_mode", "entropy_profile", "effective_overlap", "entropy_variation", "two_point_correlation", "mps_marginals")}
    model = mps.chain_of(q["mps_model_table"], "all_classes")
    assert (model.length, model.n_classes) == (LENGTH, CLASSES)
    assert q["mps_train"].count() == 3
    assert {(r.series_id, r.t) for r in q["mps_forecast"].collect()} == {(i, t) for i in range(45) for t in range(LENGTH - 3, LENGTH)}
    assert q["mps_interpolate"].count() == 45 * 3 and q["mps_forecast_mode"].count() == 45 * 2
    assert q["entropy_profile"].count() == CLASSES * (LENGTH - 1) and q["two_point_correlation"].count() == CLASSES * LENGTH**2
    assert q["effective_overlap"].count() == CLASSES * 45 and q["entropy_variation"].count() == CLASSES * LENGTH
    assert q["mps_marginals"].select("class", "t").distinct().count() == CLASSES * LENGTH


def test_measured_entropies_and_correlations_equal_dense_ones(spark):
    state = mps.right_orthogonal(mps.random_chain(6, 2, 4, 1, seed=3).of_class(0))
    s = spark.createDataFrame([(1, 0, [0.1, 0.4, 0.9, 0.3, 0.7, 0.5])], "series_id long, label int, x array<double>")
    before = mps.entropy_profile(state)
    for r in analysis.entropy_variations(s, state, "half_angle", 2).collect():
        v = s.first().x[r.t] * np.pi / 2
        p = np.array([np.cos(v), np.sin(v)])
        measured = list(state)
        measured[r.t] = np.einsum("s,u,lur->lsr", p, p, state[r.t])
        assert r.variation == pytest.approx(np.mean(np.subtract(mps.entropy_profile(measured), before)), abs=1e-8)
    o, found = mps.spin("Sz", 2), mps.two_point(state)
    one = [mps.with_operators(state, {i: o}).real for i in range(6)]
    assert found[1, 4] == pytest.approx(mps.with_operators(state, {1: o, 4: o}).real - one[1] * one[4])
    assert found[2, 2] == pytest.approx(mps.with_operators(state, {2: o @ o}).real - one[2] ** 2)


@pytest.mark.parametrize("halvings", [6, 0])
def test_entropies_read_from_pieces_equal_those_of_each_value(spark, monkeypatch, halvings):
    """Pieces that don't hold (none is halved in the second case) are computed value by value."""
    states = [mps.right_orthogonal(mps.random_chain(6, 2, 4, 2, seed=3).of_class(c)) for c in (0, 1)]
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [0.0, 1.0, *rng.random(4).tolist()]) for i in range(60)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    found = lambda: {(r.series_id, r.label, r.t): r.variation for r in analysis.entropy_variations(s, states, "stoudenmire", 2).collect()}
    want, asked, one = found(), [], analysis.measured_entropies
    monkeypatch.setattr(analysis, "PIECES_FROM", 60)
    monkeypatch.setattr(analysis, "HALVINGS", halvings)
    got = found()
    assert got.keys() == want.keys() and len(got) == 360
    assert max(abs(got[k] - want[k]) for k in want) <= 2e-10
    at, edges_of = np.concatenate(analysis._piece_points()), analysis.entropy_pieces
    forms = analysis.cut_forms(states[0], 2, analysis.side_grams(states[0]))

    def value_of(level, k):
        v = (k + (at + 1) / 2) / (analysis.FIRST << level)
        asked.append(len(v))
        return one(forms, np.stack([np.exp(1.5j * np.pi * v) * np.cos(v * np.pi / 2), np.exp(-1.5j * np.pi * v) * np.sin(v * np.pi / 2)], axis=1))

    edges, coefficients = edges_of(value_of, 0.0, 1.0, halvings)
    assert edges[0] == 0 and edges[-1] == 1 and len(edges) == len(coefficients) + 1
    assert sum(asked) <= 33 * (4 + 2 * sum(4 << k for k in range(halvings)))  # however many series there are
