"""Chains, training, sampling and searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions.scaling import scaled
from chainloom.operators import blocks, mps, prediction, sampling, search, training
from chainloom.operators.overlap import half_angle_overlap, rescaled_fidelity
from chainloom.sources import generators


@pytest.fixture(scope="module")
def sines(spark):
    s = generators.sinusoids(spark, 24, 5, (0.0, 2.0), 0.05, seed=2).withColumn("x", F.when(F.col("label") == 0, F.transform("x", lambda v: v * 0.2 + 2.0)).otherwise(F.col("x")))
    return scaled(s.select("series_id", "label", "x"))[0].persist()


def dense(chain):
    """The chain as one array (s..., class)."""
    env = np.ones((1, 1, 1), complex)  # states so far, class, bond
    for j, t in enumerate(chain.tensors):
        env = np.einsum("pcl,lsrk->pskr", env, t).reshape(-1, t.shape[3], t.shape[2]) if j == chain.centre else np.einsum("pcl,lsr->pscr", env, t).reshape(-1, env.shape[1], t.shape[2])
    return env[:, :, 0]


def test_random_chains_are_normalised():
    c = mps.random_chain(5, 3, 4, 2, seed=1)
    assert c.norm() == pytest.approx(1) and np.linalg.norm(dense(c)) == pytest.approx(1)


@pytest.mark.parametrize("j, to_left", [(2, True), (3, True)])
def test_split_gives_the_tensor_back(j, to_left):
    c = mps.random_chain(5, 2, 4, 3, seed=2)
    while c.centre > j + 1:
        c = mps.split(c, c.centre - 1, mps.merged(c, c.centre - 1), True, 99)
    new = mps.split(c, j, mps.merged(c, j), to_left, 99)
    assert new.centre == j and np.allclose(dense(new), dense(c))
    back = mps.split(new, j, mps.merged(new, j), False, 99)
    assert back.centre == j + 1 and np.allclose(dense(back), dense(c))


def test_model_table_keeps_shapes(spark):
    """Slices of zeros at the ends of a bond, of d and of the classes come back."""
    a, b = np.zeros((1, 2, 2), complex), np.zeros((2, 2, 1, 3), complex)
    a[0, 0, 0] = b[0, 0, 0, 0] = 1
    again = mps.chain_of(mps.model_table(spark, mps.Chain((a, b), 1), "z"), "z")
    assert [t.shape for t in again.tensors] == [(1, 2, 2), (2, 2, 1, 3)] and np.array_equal(again.tensors[1], b)
    with pytest.raises(ValueError):
        mps.chain_of(mps.model_table(spark, again, "z"), "other")


def test_model_table_round_trip(spark):
    c = mps.random_chain(3, 2, 2, 2, seed=3)
    again = mps.chain_of(mps.model_table(spark, c, "a").unionByName(mps.model_table(spark, mps.random_chain(2, 2, 2, 2, 1), "b")), "a")
    assert again.centre == 2 and all(np.allclose(a, b) for a, b in zip(c.tensors, again.tensors))


def test_scores_equal_the_dense_contraction(spark, sines):
    c = mps.random_chain(5, 2, 3, 2, seed=4)
    phi = {r.series_id: (np.array(r.re) + 1j * np.array(r.im)).reshape(5, 2) for r in prediction.states(sines, "stoudenmire", 2, "series_id").collect()}
    for r in prediction.scores(sines, c, "stoudenmire", 2).collect():
        state = np.ones(1)
        for p in phi[r.series_id]:
            state = np.kron(state, p.conj())
        assert r.weight == pytest.approx(np.abs(state @ dense(c)) ** 2)


@pytest.mark.parametrize("loss", ["kld", "mse", "mixed", "normalised"])
@pytest.mark.parametrize("separate", [False, True])
def test_gradients_equal_differences(sines, loss, separate):
    options = training.Options(loss=loss, separate_classes=separate)
    c, counts = mps.random_chain(5, 2, 2, 2, seed=5), {0: 12, 1: 12}
    half = blocks.HalfSweep(blocks.state_blocks(sines, "stoudenmire", 2), c, True)
    bond = mps.merged(c, 3)
    at = lambda b: training.loss_and_gradient(half, b, 3, options, counts)
    _, g = at(bond)
    rng, h = np.random.default_rng(0), 1e-6
    direction = rng.normal(size=bond.shape) + 1j * rng.normal(size=bond.shape)
    slope = (at(bond + h * direction)[0] - at(bond - h * direction)[0]) / (2 * h)
    factor = {"kld": 2, "normalised": 2, "mse": 1}.get(loss)
    if factor:  # the squared error's gradient is by the value itself, the others' by its conjugate
        assert slope == pytest.approx(factor * np.vdot(g, direction).real, rel=1e-4)


@pytest.mark.parametrize("kept", [1, 2, 100])
def test_kept_environments_are_those_of_the_chain(sines, monkeypatch, kept):
    """In both directions every update has the amplitudes that the whole chain gives, and blocks may be small."""
    monkeypatch.setattr(blocks, "KEPT", kept)
    monkeypatch.setattr(blocks, "ROWS", 5)
    base, chain = blocks.state_blocks(sines, "stoudenmire", 2), mps.random_chain(5, 2, 3, 2, seed=8)
    want = blocks.block_summary(base, chain)
    found = prediction.summary(prediction.scores(sines, chain, "stoudenmire", 2)).first()
    assert [want[k] for k in ("accuracy", "kld", "mse")] == pytest.approx([found.accuracy, found.kld, found.mse])
    for to_left in (True, False):
        half = blocks.HalfSweep(base, chain, to_left)
        for j in range(3, -1, -1) if to_left else range(4):
            loss, g = training.loss_and_gradient(half, mps.merged(chain, j), j, training.Options(), {0: 12, 1: 12})
            assert loss == pytest.approx(want["kld"]) and np.vdot(mps.merged(chain, j), g) == pytest.approx(-1)
            chain = mps.split(chain, j, mps.merged(chain, j), to_left, 10)
            half.advance(j + 1 if to_left else j, chain.tensors[j + 1 if to_left else j])
        half.close()


def test_options_by_sweep_and_stopping_on_the_test_set(sines):
    options = training.Options(sweeps=6, max_bond=[2, 3], first_bond=2, rate=(0.3, 0.0), solver=["tsgo", "descent"], stop_below=1e-9)
    assert options.of_sweep(1).rate == 0.3 and options.of_sweep(5).solver == "descent" and options.of_sweep(2).max_bond == 3
    chain, log = training.fit_scaled(sines, sines, options)
    assert len(log) == 8 and log[2]["test_kld"] == pytest.approx(log[6]["test_kld"], rel=1e-2)  # little moves after the first sweep
    stopped = training.fit(sines, sines, training.Options(sweeps=9, max_bond=3, first_bond=2, rate=0.2, stop_below=1e6))[1]
    assert len(stopped) < 11


def test_a_failed_line_search_keeps_the_tensor():
    rising = lambda b: (float("inf") if np.any(b) else 0.0, np.ones(2, complex))
    options = training.Options(solver="conjugate", iterations=3, rescale=False)
    assert not training.updated(np.zeros(2, complex), rising, options).any()


def test_training_separates_two_classes(sines):
    chain, log = training.fit(sines, sines, training.Options(sweeps=2, max_bond=4, first_bond=2, rate=0.3))
    assert log[-1]["train_accuracy"] >= 0.95 and log[-1]["train_kld"] < log[0]["train_kld"]
    assert chain.norm() == pytest.approx(1) and len(log) == 4
    with pytest.raises(ValueError):
        training.fit(sines.withColumn("label", F.col("label") + 1), None, training.Options())
    with pytest.raises(ValueError):
        training.Options().changed(colour="red")


@pytest.mark.parametrize("options", [training.Options(), training.Options(loss="mixed", solver="careful", iterations=2), training.Options(separate_classes=True, loss="normalised")])
def test_a_sweep_in_one_task_is_that_of_many(spark, sines, options):
    """One job for a sweep and one for each update give the same chain."""
    chain, counts = mps.random_chain(5, 2, 2, 2, seed=5), {0: 12, 1: 12}
    base = blocks.state_blocks(sines, "stoudenmire", 2)
    assert base.getNumPartitions() == 1
    many = base.flatMap(lambda b: [(b[0][k::3], b[1][k::3]) for k in range(3)]).repartition(3).cache()
    a, b = (training.sweep_of(x, chain, options, counts) for x in (base, many))
    assert np.allclose(dense(a), dense(b)) and not np.allclose(dense(a), dense(chain))


def test_a_tensor_that_isn_t_finite_stops_the_fit(sines):
    with pytest.raises(FloatingPointError, match="sweep 1, sites"):
        training.fit(sines, None, training.Options(loss=lambda y, label: (np.full(len(y), np.nan), np.full_like(y, np.nan)), sweeps=1, first_bond=2))


@pytest.mark.parametrize("solver", ["descent", "careful", "conjugate", "TSGO"])
def test_solvers_lower_a_quadratic(solver):
    goal = np.array([1.0 + 1j, 2.0])
    evaluate = lambda b: (float(np.sum(np.abs(b - goal) ** 2)), b - goal)
    b = training.updated(np.zeros(2, complex), evaluate, training.Options(solver=solver, iterations=8, rate=0.3, rescale=False))
    assert evaluate(b)[0] < evaluate(np.zeros(2))[0] / 2


def test_entropy_of_a_product_state_is_zero_and_of_a_pair_ln_2():
    product = [np.array([0.6, 0.8]).reshape(1, 2, 1)] * 4
    assert mps.entropy_profile(product) == pytest.approx([0, 0, 0], abs=1e-9)
    pair = [np.eye(2).reshape(1, 2, 2), np.eye(2).reshape(2, 2, 1)]
    assert mps.entropy_profile(pair) == pytest.approx([np.log(2)]) and mps.entropy_profile(pair, 2) == pytest.approx([1])
    assert mps.two_point(pair)[0, 1] == pytest.approx(0.25)


def test_difference_is_orthogonal():
    c = mps.random_chain(4, 2, 3, 2, seed=6)
    a, b = mps.right_orthogonal(c.of_class(0)), mps.right_orthogonal(c.of_class(1))
    rest = mps.difference(a, b)
    assert abs(mps.inner(rest, rest)) == pytest.approx(1) and abs(mps.inner(a, rest)) == pytest.approx(0, abs=1e-9)


def test_samples_don_t_depend_on_partitioning(spark, sines):
    state = mps.right_orthogonal(mps.random_chain(5, 2, 3, 2, seed=7).of_class(0))
    a = sampling.forecast(sines, state, "stoudenmire", 2, 2, 5).orderBy("series_id", "shot", "t").collect()
    b = sampling.forecast(sines.repartition(5), state, "stoudenmire", 2, 2, 5).orderBy("series_id", "shot", "t").collect()
    assert [tuple(r)[:3] for r in a] == [tuple(r)[:3] for r in b] and [r.x for r in a] == pytest.approx([r.x for r in b])
    assert all(0 <= r.x <= 1 for r in a) and len(a) == 24 * 5 * 2
    assert sampling.imputed(sines, state, "stoudenmire", 2, [], 5).count() == 0


def test_samples_follow_the_density(spark):
    """In a product state the other sites say nothing: draws follow that site's density."""
    state = [np.array([0.6, 0.8]).reshape(1, 2, 1)] * 3
    one = spark.createDataFrame([(1, 0, [0.5, 0.5, 0.5])], "series_id long, label int, x array<double>")
    x = np.sort([r.x for r in sampling.imputed(one, state, "half_angle", 2, [1], 2000).collect()])
    grid = np.linspace(0, 1, 2001)
    p = (0.6 * np.cos(np.pi / 2 * grid) + 0.8 * np.sin(np.pi / 2 * grid)) ** 2
    cdf = np.cumsum(p) / p.sum()
    assert np.abs(np.interp(x, grid, cdf) - (np.arange(2000) + 0.5) / 2000).max() < 0.05
    m = sampling.marginals(spark, state, "half_angle", 2, 101).filter("t = 1").orderBy("x").toPandas()
    assert np.allclose(m.p, np.interp(m.x, grid, p / p.mean()), rtol=1e-2)
    mode = sampling.bootstrapped_mode(sampling.imputed(one, state, "half_angle", 2, [1], 300), 50).first()
    assert abs(mode["mode"] - grid[p.argmax()]) < 0.25


def test_time_ordered_interpolation_ignores_later_sites(spark, sines):
    """The draws of a site depend on what is before it: with other values after it they are the same."""
    state = mps.right_orthogonal(mps.random_chain(5, 2, 3, 2, seed=7).of_class(0))
    other = sines.withColumn("x", F.concat(F.slice("x", 1, 3), F.array(F.lit(0.9), F.lit(0.1))))
    draws = lambda s, ordered: [r.x for r in sampling.imputed(s, state, "stoudenmire", 2, [2], 3, ordered=ordered).orderBy("series_id", "shot").collect()]
    assert draws(sines, True) == pytest.approx(draws(other, True)) and draws(sines, False) != pytest.approx(draws(other, False))
    last = lambda ordered: [r.x for r in sampling.imputed(sines, state, "stoudenmire", 2, [3, 4], 3, ordered=ordered).orderBy("series_id", "shot", "t").collect()]
    assert last(True) == pytest.approx(last(False))  # a forecast has nothing after it


def test_class_forecast_scores_and_sweeps(spark, sines):
    chain = mps.random_chain(5, 2, 3, 2, seed=7)
    class_states = [mps.right_orthogonal(chain.of_class(c)) for c in range(2)]
    got = {r.label: r for r in sampling.class_forecast_scores(sines, class_states, "stoudenmire", 2, 2, 6).collect()}
    assert {c: r.n_series for c, r in got.items()} == {0: 12, 1: 12}
    values = {(r.series_id, r.label): r.x for r in sines.collect()}
    for c in (0, 1):
        own = sines.filter(F.col("label") == c)
        means = {(r.series_id, r.t): r["mean"] for r in sampling.trajectories(sampling.forecast(own, class_states[c], "stoudenmire", 2, 2, 6)).collect()}
        errors = [abs(m - values[i, c][t]) for (i, t), m in means.items()]
        assert len(errors) == 24 and got[c].mae == pytest.approx(sum(errors) / 24)
    swept = {(r.horizon, r.shots): r for r in sampling.forecast_sweep(sines.filter("label = 0"), class_states[0], "stoudenmire", 2, [1, 2], [2, 6]).collect()}
    assert set(swept) == {(1, 2), (1, 6), (2, 2), (2, 6)} and swept[2, 6].mae == pytest.approx(got[0].mae)


def test_grids_of_other_parameters_are_refused_and_cells_run_together(spark, sines, tmp_path):
    options, path = training.Options(sweeps=1, first_bond=2), str(tmp_path / "results")
    cells = search.grid(spark, 2, [0.1], [2], [2, 3], ["half_angle"])
    found = search.run_grid(sines, cells, path, 2, options, parallel=3)
    assert found.select(*search.CELL).distinct().count() == 4
    with pytest.raises(ValueError, match="another run"):
        search.run_grid(sines, cells, path, 2, options.changed(sweeps=2))
    search.write_report(spark, str(tmp_path / "report"), options, [{"sweep": 1, "train_kld": 0.5, "test_kld": None}], spark.createDataFrame([(0, 1, 7)], "truth int, predicted int, n long"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "sweep 1; train_kld 0.5" in lines and "true 0, predicted 1: 7" in lines and "sweeps = 1" in lines


def test_grids_resume(spark, sines, tmp_path):
    options = training.Options(sweeps=1, first_bond=2)
    cells = search.grid(spark, 2, [0.1], [2], [2, 3], ["half_angle", "fourier"])
    path = str(tmp_path / "results")
    first = search.run_grid(sines, cells.filter("max_bond = 2 AND encoding = 'half_angle'"), path, 2, options)
    assert first.select(*search.CELL).distinct().count() == 2
    assert search.remaining(cells, first).count() == 6
    again = search.run_grid(sines, cells.filter("max_bond = 2 AND encoding = 'half_angle'"), path, 2, options)
    assert again.count() == first.count()
    means = search.fold_means(again, 2)
    assert means.filter("test_accuracy IS NULL").count() == 0 and search.fold_means(again.filter("fold = 1"), 2).filter("test_accuracy IS NOT NULL").count() == 0
    assert {r.criterion for r in search.best_cells(means).collect()} == {"accuracy", "kld"}
    assert search.heat_map(means, "d", "max_bond", "test_accuracy", [2, 3]).columns == ["d", "2", "3"]
    assert search.regular_axes(means, "d", [2, 3], "max_bond", [2]).count() >= 2
    assert search.sweep_changes(again).filter("sweep = 0 AND change IS NOT NULL").count() == 0


def test_rescaled_fidelity_of_base_ten_is_the_overlap(spark):
    df = spark.createDataFrame([([0.1, 0.9], [0.3, 0.2])], "x array<double>, y array<double>")
    o = half_angle_overlap(F.col("x"), F.col("y"))
    r = df.select(o.alias("o"), rescaled_fidelity(o, 10.0).alias("f")).first()
    assert r.f == pytest.approx(abs(r.o)) and r.o == pytest.approx(np.cos(0.1 * np.pi) * np.cos(0.35 * np.pi))


def test_streams(spark, tmp_path, sines):
    from chainloom.streaming import scoring

    sines.write.parquet(str(tmp_path / "in"))
    c = mps.random_chain(5, 2, 2, 2, seed=9)
    stream = spark.readStream.schema(sines.schema).parquet(str(tmp_path / "in"))
    q = scoring.scored_stream(stream, c, "stoudenmire", 2).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = prediction.predictions(prediction.scores(sines, c, "stoudenmire", 2))
    assert sorted((r.series_id, r.predicted) for r in spark.table("scored").collect()) == sorted((r.series_id, r.predicted) for r in batch.collect())
    events = spark.range(96).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    days = {(r.k, r.start.day): r.means for r in scoring.windowed_series(events, "ts", "k", "v").collect()}
    assert len(days) == 4 and days[0, 1][:3] == [0.0, 2.0, 4.0]
    pairs = events.select("ts", "k", F.col("v").alias("actual"), (F.col("v") + 1).alias("forecast"))
    assert {r.mae for r in scoring.running_errors(pairs, "ts", "k").collect()} == {1.0}


def test_sum_states_hold_their_series(spark, sines):
    options = training.Options(first_bond=8)
    start = training.sum_state_start(sines, options, per_class=3)
    found = prediction.scores(sines, start, "stoudenmire", 2)
    from chainloom.operators.series import hashed, sampled_per_class

    own = sampled_per_class(sines, 3, hashed(options.seed)).select("series_id")
    assert prediction.summary(found.join(own, "series_id")).first().accuracy == 1.0
    phi = np.random.default_rng(3).normal(size=(3, 4, 2)) + 0j
    whole = mps.sum_of_products(phi, [0, 1, 1], 2)
    want = np.zeros((16, 2), complex)
    for p, c in zip(phi, [0, 1, 1]):
        want[:, c] += np.kron(np.kron(p[0], p[1]), np.kron(p[2], p[3]))
    assert np.allclose(dense(whole), want / np.linalg.norm(want))
    assert np.allclose(dense(mps.compressed(whole, 8)), dense(whole))


@pytest.mark.parametrize("options", [training.Options(partition=True), training.Options(norm_penalty=0.2)])
def test_gradients_of_the_norm(sines, options):
    c = mps.random_chain(5, 2, 2, 1, seed=5)
    half = blocks.HalfSweep(blocks.state_blocks(sines.withColumn("label", F.lit(0)), "stoudenmire", 2), c, True)
    bond, rng, h = mps.merged(c, 3) * 1.3, np.random.default_rng(0), 1e-6
    direction = rng.normal(size=bond.shape) + 1j * rng.normal(size=bond.shape)
    at = lambda b, o: training.loss_and_gradient(half, b, 3, o, {0: 24})
    extra = lambda b: at(b, options)[0] - at(b, training.Options())[0]
    g = at(bond, options)[1] - at(bond, training.Options())[1]
    slope = (extra(bond + h * direction) - extra(bond - h * direction)) / (2 * h)
    assert slope == pytest.approx((2 if options.partition else 1) * np.vdot(g, direction).real, rel=1e-3)


def test_one_site_overlaps_and_variations(spark):
    from chainloom.operators import analysis

    one = spark.createDataFrame([(1, 0, [0.2, 0.7])], "series_id long, label int, x array<double>")
    state = [np.array([1.0, 0.0]).reshape(1, 2, 1), np.array([0.0, 1.0]).reshape(1, 2, 1)]
    got = {r.t: r.overlap for r in analysis.site_overlaps(one, state, "half_angle", 2).collect()}
    assert got == {0: pytest.approx(np.cos(0.1 * np.pi) ** 2), 1: pytest.approx(np.sin(0.35 * np.pi) ** 2)}
    pair = [np.eye(2).reshape(1, 2, 2) / 2**0.5, np.eye(2).reshape(2, 2, 1)]
    assert [r.variation for r in analysis.entropy_variations(one, pair, "half_angle", 2).collect()] == pytest.approx([-np.log(2)] * 2)


def test_projection_finds_the_constant_term_of_a_flat_density(spark):
    from chainloom.operators import analysis

    s = spark.createDataFrame([(k, 0, [-1 + 2 * k / 99]) for k in range(100)], "series_id long, label int, x array<double>")
    best = analysis.projected_basis(s, "fourier", 2, terms=6).orderBy("place").collect()
    assert best[0].term == 0 and best[0].weight > 10 * best[1].weight
    assert analysis.projected_basis(s, "legendre", 2, terms=6).filter("place = 0").first().term == 0


def test_scaling_to_the_plane_keeps_distances(spark):
    from chainloom.operators import analysis

    rows = [(i, j, float(np.cos(i - j))) for i in range(3) for j in range(3)]
    x = analysis.embedded(spark.createDataFrame(rows, "query_id long, series_id long, overlap double")).toPandas().pivot(index="series_id", columns="axis", values="x").to_numpy()
    assert np.linalg.norm(x[0] - x[1]) == pytest.approx(np.sqrt(2 - 2 * np.cos(1)), rel=1e-6)
    rows += [(i, 7, float(np.cos(i - 1))) for i in range(3)]  # no landmark, where series 1 is
    y = analysis.embedded(spark.createDataFrame(rows, "query_id long, series_id long, overlap double")).toPandas().pivot(index="series_id", columns="axis", values="x")
    assert np.allclose(y.loc[[0, 1, 2]], x) and np.allclose(y.loc[7], y.loc[1])
    many = spark.range(600).selectExpr("id AS query_id", "id AS series_id", "1.0D AS overlap")
    with pytest.raises(ValueError, match="landmarks"):
        analysis.embedded(many)
