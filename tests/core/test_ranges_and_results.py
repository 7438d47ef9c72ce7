"""Contraction of long chains, two routes of contraction, and the algebra of results, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import encodings
from chainloom.operators import contraction, mps, prediction, ranges, search, series as S


def plain_logs(chain, phi):
    """Logarithms of squared outputs: vectors are brought to norm 1 after every site and the logarithms of the norms added up."""
    env, log = np.ones((1, 1), complex), 0.0
    for j, (t, p) in enumerate(zip(chain.tensors, phi)):
        env = np.einsum("cl,s,lsrk->kr", env, p.conj(), t) if j == chain.centre else np.einsum("cl,s,lsr->cr", env, p.conj(), t)
        n = np.linalg.norm(env)
        env, log = env / n, log + math.log(n)
    return 2 * (np.log(np.abs(env[:, 0])) + log)


@pytest.mark.parametrize("scale", [1.0, 0.01, 50.0])
def test_two_thousand_sites_stay_in_range(spark, scale):
    r, length = np.random.default_rng(1), 2000
    chain = mps.random_chain(length, 2, 3, 2, seed=2)
    chain = chain.with_sites(0, *[t * scale for t in chain.tensors], centre=chain.centre)
    rows = [(k, k % 2, [float(v) for v in r.random(length)]) for k in range(6)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    scored = ranges.log_scores(s, chain, "half_angle", 2)
    got = {g.series_id: g.log_weight for g in scored.collect()}
    norms = []
    for k, _, x in rows:
        phi = np.stack([np.cos(np.pi / 2 * np.array(x)), np.sin(np.pi / 2 * np.array(x))], axis=1) + 0j
        want = plain_logs(chain, phi)
        assert got[k] == pytest.approx(want.tolist(), rel=1e-9)
        norms.append(np.logaddexp.reduce(want) / 2)
    if scale != 1.0:  # the plain route is out of range
        with np.errstate(all="ignore"):
            weights = prediction.scores(s, chain, "half_angle", 2).first().weight
        assert not any(0 < w < float("inf") for w in weights)
    found = ranges.output_range(scored).first()
    assert (found.least, found.greatest, found.n, found.n_zero) == (pytest.approx(min(norms)), pytest.approx(max(norms)), 6, 0)
    again = ranges.in_range(s, chain, "half_angle", 2)
    after = ranges.output_range(ranges.log_scores(s, again, "half_angle", 2)).first()
    if found.greatest > math.log(1e5):
        assert after.greatest == pytest.approx(math.log(1e4))
    else:
        assert after.least == pytest.approx(math.log(1e-5))
    assert ranges.log_predictions(scored).select("predicted").collect() == ranges.log_predictions(ranges.log_scores(s, again, "half_angle", 2)).select("predicted").collect()


def test_zeros_and_empty_tables_have_a_range(spark):
    chain = mps.Chain((np.array([1.0, 0.0]).reshape(1, 2, 1, 1),), 0)
    s = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [0.5])], "series_id long, label int, x array<double>")
    null = mps.Chain((np.zeros((1, 2, 1, 1)),), 0)
    assert ranges.output_range(ranges.log_scores(s, null, "half_angle", 2)).first().n_zero == 2
    assert ranges.in_range(s, null, "half_angle", 2) is null and ranges.in_range(s.limit(0), chain, "half_angle", 2) is chain
    fine = mps.Chain((np.array([0.6, 0.8]).reshape(1, 2, 1, 1),), 0)
    assert ranges.in_range(s, fine, "half_angle", 2) is fine


@pytest.mark.parametrize("encoding, d", [("stoudenmire", 2), ("fourier", 3), ("half_angle", 2)])
def test_two_routes_agree_and_a_damaged_entry_is_found(spark, encoding, d):
    r = np.random.default_rng(7)
    e = encodings.ENCODINGS[encoding]
    rows = [(k, k % 3, [float(v) for v in r.uniform(e.low, e.high, 5)]) for k in range(9)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    chain = mps.compressed(mps.random_chain(5, d, 3, 3, seed=5), 3)
    for centre in (4, 2):
        for j in range(chain.centre - 1, centre - 1, -1):
            chain = mps.split(chain, j, mps.merged(chain, j), True, 9)
        entries, local, weights = mps.model_table(spark, chain, "m"), encodings.encoded(s, encoding, d), prediction.scores(s, chain, encoding, d)
        found = contraction.relational_amplitudes(local, entries, 5)
        assert found.count() == 27 and contraction.disagreeing(weights, found).count() == 0
        hit = (F.col("site") == centre) & (F.col("c") == 1) & (F.col("l") == 0) & (F.col("s") == 0) & (F.col("r") == 0)
        damaged = entries.withColumn("im", F.when(hit, F.col("im") + 0.5).otherwise(F.col("im")))
        bad = contraction.disagreeing(weights, contraction.relational_amplitudes(local, damaged, 5)).collect()
        assert {b.c for b in bad} == {1} and len(bad) == 9
    gone = contraction.disagreeing(weights, found.filter("series_id <> 4")).collect()
    assert {(b.series_id, b.relational) for b in gone} == {(4, 0.0)}


CELLS = [(f, s, d) for f in (1, 2, 3) for s in (0, 1, 2, 3) for d in (2, 3)]


@pytest.fixture(scope="module")
def results(spark):
    r = np.random.default_rng(9)
    rows = [(f, 0.1, d, 4, "fourier", s, *[float(v) for v in r.random(4)], 1.0 + s, None, "run") for f, s, d in CELLS if (f, d) != (3, 3) or s < 3]
    rows[0] = (*rows[0][:9], None, *rows[0][10:])  # a part of fold 1, sweep 0, d 2 is missing
    return spark.createDataFrame(rows, search.RESULT_SCHEMA).cache()


def test_statistics_of_folds_equal_plain_python(results):
    rows, got = results.collect(), {(g.sweep, g.d): g for g in search.fold_statistics(results, 3).collect()}
    for s in range(4):
        for d in (2, 3):
            own = [r for r in rows if r.sweep == s and r.d == d]
            if len(own) < 3 or any(r[m] is None for r in own for m in search.MEASURES):
                assert got[s, d]["mean"] is None and got[s, d].deviation is None
                continue
            for m in search.MEASURES:
                assert got[s, d]["mean"][m] == pytest.approx(np.mean([r[m] for r in own]))
                assert got[s, d].deviation[m] == pytest.approx(np.std([r[m] for r in own]))


def test_arithmetic_of_results_is_missing_where_a_part_is(results):
    df = search.measured(results)
    r = F.col("r")
    made = df.select("r", search.combined("+", r, r).alias("double"), search.combined("^", r, 2).alias("power"), search.combined("/", r, 0).alias("none"), search.applied("sqrt", search.applied("-", r)).alias("nan"), search.applied("abs", search.applied("-", r)).alias("same")).collect()
    assert sum(g.r is None for g in made) == 1
    for g in made:
        if g.r is None:
            assert g.double is None and g.power is None and g.same is None
        else:
            assert g.double.test_kld == pytest.approx(2 * g.r.test_kld) and g.power.train_kld == pytest.approx(g.r.train_kld**2) and g.same == g.r
        assert g.none is None and g.nan is None
    assert search.summed(df, ["d"]).filter("d = 2").first().r is None


def test_heat_maps_are_balanced_by_the_untrained_chain(results):
    means = search.fold_means(results, 3)
    rows = results.collect()
    got = {(g.sweep, g.d): g.balanced for g in search.balanced_by_untrained(means).collect()}
    mean = lambda s, d: np.mean([r.test_kld for r in rows if r.sweep == s and r.d == d])
    assert got[2, 3] == pytest.approx(mean(0, 3) - mean(2, 3)) and got[0, 3] == pytest.approx(0) and got[3, 3] is None  # a fold is missing
    mapped = search.heat_map(search.balanced_by_untrained(means).filter("sweep = 2"), "d", "max_bond", "balanced", [4]).collect()
    assert {m.d: m["4"] for m in mapped}[3] == pytest.approx(got[2, 3])
    assert search.balanced_by_untrained(means.filter("sweep > 0")).filter("balanced IS NOT NULL").count() == 0


def test_tables_of_sweeps_and_curves(results):
    rows = {(g.fold, g.d, g.measure): g for g in search.sweep_table(results).collect()}
    g = rows[2, 2, "seconds"]
    assert (g.initial, g.sweeps, g.after_norm, g["mean"]) == (1.0, [2.0, 3.0], 4.0, 2.5)
    curve = search.training_curve(search.fold_means(results, 3), {"d": 3, "encoding": "fourier"}).collect()
    assert [c.sweep for c in curve] == [0, 1, 2, 3] and curve[3].test_accuracy is None


def test_stacked_subsets_are_balanced(spark):
    rows = [(k, k % 7, [1.0]) for k in range(100)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    got = S.stacked(s, {0: 0, 1: 0, 2: 1, 5: 1, 6: 1}, F.col("series_id")).collect()
    sizes = {c: [r.series_id for r in got if r.label == c] for c in (0, 1)}
    assert len(sizes[0]) == len(sizes[1]) == sum(k % 7 in (0, 1) for k in range(100))
    assert sorted(sizes[1]) == [k for k in range(100) if k % 7 in (2, 5, 6)][: len(sizes[0])]


@pytest.mark.parametrize("cuts", [[], [5], [1, 4, 9, 16, 25, 36, 49], list(range(0, 100, 3))])
def test_slices_count_the_cuts_below(spark, cuts):
    df = spark.range(-2, 103).select("id", S.slice_of(F.col("id"), cuts).alias("s"))
    assert all(r.s == sum(c < r.id for c in cuts) for r in df.collect())


def test_training_on_long_series_stays_in_range(spark):
    """Outputs of the untrained chain are of the size 2**-700; squared, they are no doubles."""
    from chainloom.operators import training

    r, length = np.random.default_rng(3), 1400
    rows = [(k, k % 2, [float(v) for v in r.random(length)]) for k in range(4)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    start = mps.random_chain(length, 2, 2, 2, seed=4)
    chain, log = training.fit(s, None, training.Options(encoding="half_angle", sweeps=1, max_bond=3, first_bond=2, rate=0.3), start)
    want = [-plain_logs(start, np.stack([np.cos(np.pi / 2 * np.array(x)), np.sin(np.pi / 2 * np.array(x))], axis=1) + 0j)[label] for _, label, x in rows]
    assert log[0]["train_kld"] == pytest.approx(np.mean(want), rel=1e-9) and np.mean(want) > 745
    assert log[1]["train_kld"] < log[0]["train_kld"] / 2 and np.isfinite([x["train_kld"] for x in log]).all()


@pytest.mark.parametrize("broadcast_bytes, salted_rows", [(1 << 20, 10), (0, 7), (0, 1000)])
def test_overlaps_by_broadcast_or_salted_shuffle_are_equal(spark, broadcast_bytes, salted_rows):
    from chainloom.operators import overlap

    r = np.random.default_rng(5)
    rows = [(k, 0, [float(v) for v in r.random(3)]) for k in range(40)]
    s = spark.createDataFrame(rows, "series_id long, label int, x array<double>")
    got = {(g.query_id, g.series_id): g.overlap for g in overlap.overlaps(s, s.filter("series_id % 3 = 0"), block=4, broadcast_bytes=broadcast_bytes, salted_rows=salted_rows).collect()}
    want = {(a, b): np.cos(np.pi / 2 * (np.array(x) - np.array(y))).prod() for a, _, x in rows if a % 3 == 0 for b, _, y in rows}
    assert got == pytest.approx(want)
    assert overlap.overlaps(s, s.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_a_chain_is_contracted_where_its_series_are(spark, monkeypatch):
    """However long the chain: series are dealt out once, by their number, and nothing of theirs is shuffled after that."""
    monkeypatch.setattr(contraction, "TASK_SERIES", 5)
    r, length = np.random.default_rng(3), 7
    s = spark.createDataFrame([(k, 0, [float(v) for v in r.random(length)]) for k in range(23)], "series_id long, label int, x array<double>")
    chain = mps.random_chain(length, 2, 3, 2, seed=2)
    dealt = contraction.dealt(s)
    assert dealt.rdd.getNumPartitions() == 5
    found = contraction.relational_amplitudes(encodings.encoded(dealt, "half_angle", 2), mps.model_table(spark, chain, "m"), length)
    plan = found._jdf.queryExecution().sparkPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
    assert plan[1].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan[1] and plan[1].count("Scan") <= 2
    assert found.count() == 46 and contraction.disagreeing(prediction.scores(s, chain, "half_angle", 2), found).count() == 0
