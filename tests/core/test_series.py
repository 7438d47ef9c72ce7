"""Sources, shaping, scaling and encodings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import encodings, scaling
from chainloom.functions.quantiles import exact_quantiles
from chainloom.operators import metrics, series as S
from chainloom.sources import generators, text, tsf


def series(spark, rows):
    return spark.createDataFrame(rows, "series_id long, label int, x array<double>")


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1.0 0.5 -2e-1\n\n  0.0   3 4.25 \n")
    got = text.read_labelled(spark, str(tmp_path / "in.txt"))
    rows = sorted((r.label, r.x) for r in got.collect())
    assert rows == [(0, [3.0, 4.25]), (1, [0.5, -0.2])]
    text.write_labelled(got, str(tmp_path / "out"))
    assert sorted((r.label, r.x) for r in text.read_labelled(spark, str(tmp_path / "out")).collect()) == rows


def test_tsf(spark, tmp_path):
    (tmp_path / "a.tsf").write_text("# c\n@relation x\n@frequency daily\n@data\nT1:1850-01-01 00-00-00:1,2.5,?\nT2:1900-05-06 03-00-00:7\n")
    rows = {r.series_name: r for r in tsf.read_tsf(spark, str(tmp_path / "a.tsf")).collect()}
    assert rows["T1"].x == [1.0, 2.5, None] and rows["T1"].frequency == "daily" and rows["T2"].start_ts.hour == 3
    long = tsf.exploded(tsf.read_tsf(spark, str(tmp_path / "a.tsf"))).filter("series_name = 'T1'").orderBy("ts").collect()
    assert [str(r.ts.date()) for r in long] == ["1850-01-01", "1850-01-02", "1850-01-03"]


@pytest.mark.parametrize("frequency, second", [("hourly", "2020-01-31 01:00:00"), ("monthly", "2020-02-29 00:00:00"), ("weekly", "2020-02-07 00:00:00"), ("yearly", "2021-01-31 00:00:00"), ("10_minutes", "2020-01-31 00:10:00")])
def test_tsf_steps(spark, tmp_path, frequency, second):
    (tmp_path / "a.tsf").write_text(f"@frequency {frequency}\n@data\nT1:2020-01-31 00-00-00:1,2\n")
    assert str(tsf.exploded(tsf.read_tsf(spark, str(tmp_path / "a.tsf"))).orderBy("ts").collect()[1].ts) == second


def test_tsf_of_an_unknown_frequency_fails(spark, tmp_path):
    (tmp_path / "a.tsf").write_text("@frequency fortnightly\n@data\nT1:2020-01-31 00-00-00:1,2\n")
    with pytest.raises(Exception, match="fortnightly"):
        tsf.exploded(tsf.read_tsf(spark, str(tmp_path / "a.tsf"))).collect()


@pytest.mark.parametrize("values", [[1.0], [5.0] * 9, [3.0, 1.0, 2.0], list(np.random.default_rng(0).normal(size=20_000)), [0.0] * 9000 + [1.0, -1e9, 1e300]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    want = np.quantile(values, [0, 0.25, 0.5, 0.9, 1])
    assert exact_quantiles(df, F.col("v"), [0, 0.25, 0.5, 0.9, 1]) == pytest.approx(list(want), rel=1e-12)
    assert exact_quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_constant_series_scale_to_the_low_end(spark):
    s = series(spark, [(1, 0, [2.0, 2.0]), (2, 1, [2.0, 2.0])])
    assert all(r.x == [0.0, 0.0] for r in scaling.scaled(s)[0].collect())


def test_own_and_training_extrema(spark):
    a, b = series(spark, [(1, 0, [0.0, 1.0, 2.0, 3.0])]), series(spark, [(2, 0, [1.0, 2.0])])
    assert scaling.scaled(a, b)[1].first().x == pytest.approx([0.0, 1.0])
    low, high = scaling.scaled(a, b, minmax_fit="train")[1].first().x
    assert 0 < low < high < 1


@pytest.mark.parametrize("name", ["stoudenmire", "half_angle", "fourier", "linear"])
@pytest.mark.parametrize("v", [0.0, 0.3, 0.5, 1.0])
def test_states_have_unit_norm(spark, name, v):
    d = 5 if name == "fourier" else 2
    z = encodings.encoded(series(spark, [(1, 0, [v])]), name, d).collect()
    assert sum(r.re**2 + r.im**2 for r in z) == pytest.approx(1)


def test_values_out_of_range_fail(spark):
    with pytest.raises(Exception, match="outside"):
        encodings.encoded(series(spark, [(1, 0, [0.2, 1.5])]), "stoudenmire", 2).collect()
    with pytest.raises(ValueError):
        encodings.encoded(series(spark, [(1, 0, [0.2])]), "sahand", 3)


def plain_edges(samples, n_bins, low, high):
    s, n = sorted(samples), len(samples)
    step = max(1, round(n / n_bins))
    inner = [(s[k * step - 1] + s[k * step]) / 2 for k in range(1, n_bins) if k * step < n]
    return [low, *inner, *[high] * (n_bins - len(inner))]


@pytest.mark.parametrize("samples", [[0.1, 0.2, 0.3, 0.4, 0.5], [0.5] * 6, [0.1], [0.1, 0.1, 0.9, 0.9, 0.9], list(np.random.default_rng(1).random(101))])
def test_histogram_edges(spark, samples):
    s = series(spark, [(k, 0, [float(v)]) for k, v in enumerate(samples)])
    assert encodings.histogram_edges(s, 4, 0.0, 1.0).first().edges == pytest.approx(plain_edges(samples, 4, 0.0, 1.0))


def test_bins_of_no_width_weigh_nothing(spark):
    df = spark.createDataFrame([(0.5,)], "v double").withColumn("edges", F.array(*[F.lit(x) for x in (0.0, 0.5, 0.5, 1.0)]))
    row = df.select(*encodings.split_on_edges(F.col("v"), F.col("edges"), 3, encodings.half_angle, 2)).first()
    assert list(row[2:4]) == [0.0, 0.0] and row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(0.5) and row[4] == pytest.approx(0.5)


def test_folds_and_splits(spark):
    s = series(spark, [(k, k % 3 if k < 30 else 7, [0.0]) for k in range(37)])
    folds = S.stratified_folds(s, 4, S.hashed(3)).collect()
    for label in (0, 1, 2, 7):
        sizes = [sum(r.fold == f and r.label == label for r in folds) for f in range(1, 5)]
        assert max(sizes) - min(sizes) <= 1
    assert {r.label: r.n for r in S.class_counts(S.balanced(s, S.hashed(1))).collect()} == {0: 7, 1: 7, 2: 7, 7: 7}
    assert [r.label_index for r in S.label_index(s).orderBy("label").collect()] == [1, 2, 3, 4]
    split = S.random_split(s, {"a": 0.6, "b": 0.2, "c": 0.2}, 1)
    assert {r.split for r in split.collect()} <= {"a", "b", "c"} and split.filter("split IS NULL").count() == 0
    with pytest.raises(ValueError):
        S.asserted(series(spark, [(1, 0, [1.0]), (2, 0, [1.0, 2.0])]))
    assert S.asserted(s) == 1


def test_long_and_array_forms(spark):
    s = series(spark, [(1, 0, [3.0, 1.0, 2.0])])
    assert S.array_form(S.long_form(s)).first().x == [3.0, 1.0, 2.0]
    assert S.head_of(s, 1).first().x == [3.0, 1.0] and S.tail_of(s, 1).first().x == [2.0]


def test_generators_are_the_same_in_any_partitioning(spark):
    a = generators.sinusoids(spark, 10, 20, noise=0.1, seed=4).orderBy("series_id").collect()
    assert a == generators.sinusoids(spark, 10, 20, noise=0.1, seed=4).repartition(3).orderBy("series_id").collect()
    assert len(a[0].x) == 20 and {r.label for r in a} == {0, 1}
    assert sorted(r.x for r in generators.constant_classes(spark, 2, 3).collect()) == [[0.0] * 3] * 2 + [[1.0] * 3] * 2
    for tries in (64, 1):
        pairs = generators.truncated_pairs(spark, 200, tries=tries).collect()
        assert len(pairs) == 400 and all(0 <= v <= 1 for r in pairs for v in r.x)
        assert all(abs(sum(r.x[0] for r in pairs if r.label == c) / 200 - m) < 0.05 for c, m in ((0, 0.3), (1, 0.7)))
    noise = generators.sine_or_noise(spark, 200, 50, seed=1).filter("label = 1").select(F.explode("x").alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(noise[0]) < 0.05 and abs(noise[1] - 1) < 0.05
    still = generators.trended(spark, 4, 30, parameters=((1.0, 2.0, 0.5, 0.0),)).collect()
    assert len(still) == 4 and all(r.x[29] - r.x[0] == pytest.approx(0.5 * 29) for r in still)  # two whole turns
    assert 0 < generators.box_labels(spark.range(100).select((F.col("id") / 100).alias("v")), 20).agg(F.avg("label")).first()[0] < 1


def test_errors_guard_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0)], "k string, actual double, forecast double")
    r = metrics.forecast_errors(df, ["k"]).first()
    assert (r.mape, r.mse, r.mae, r.rmse) == (0.5, 1.0, 1.0, 1.0) and r.smape == pytest.approx((2 + 2 / 3) / 2)
    assert metrics.binary_scores(spark.createDataFrame([(1, 1)], "t int, p int"), "t", "p").first().specificity is None
    assert math.isclose(metrics.histogram_mode(df, ["k"], "actual", 2).first().mode, 0.5)


@pytest.mark.parametrize("few, bins", [(1024, 1024), (5, 16)])
def test_grouped_quantiles(spark, monkeypatch, few, bins):
    """Of long, short, tied and null groups; with small limits in several passes."""
    import numpy as np

    from chainloom.functions import quantiles

    monkeypatch.setattr(quantiles, "GROUP_FEW", few)
    monkeypatch.setattr(quantiles, "GROUP_BINS", bins)
    r = np.random.default_rng(5)
    groups = {"a": r.normal(size=700), "b": np.r_[r.normal(size=50), [0.25] * 400, [1e9]], None: r.integers(0, 4, 300).astype(float), "c": np.array([3.5]), "d": np.array([7.0] * 60)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    found = quantiles.grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]).collect()
    assert {x.g for x in found} == set(groups) and {x.g: x.n for x in found} == {g: len(v) for g, v in groups.items()}
    for x in found:
        assert x.quantiles == pytest.approx(np.quantile(groups[x.g], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]).tolist(), rel=1e-12)


def test_symbols_without_a_state_fail(spark):
    from chainloom.functions import encodings

    symbols = spark.createDataFrame([(1, 0, "a"), (1, 1, "c")], "series_id long, t int, symbol string")
    assert [r.re for r in encodings.number_states(symbols, encodings.letter_number(F.col("symbol")), 3).orderBy("t", "k").collect()] == [1, 0, 0, 0, 0, 1]
    with pytest.raises(Exception, match="no state"):
        encodings.number_states(symbols, encodings.letter_number(F.col("symbol")), 2).collect()


def test_series_are_sorted_by_class(spark):
    rows = spark.createDataFrame([(3, 0, [1.0]), (1, 1, [1.0]), (2, 0, [1.0])], "series_id long, label int, x array<double>")
    assert [r.series_id for r in S.sorted_by_class(rows).collect()] == [2, 3, 1]


HARD = {
    "infinite": [float("-inf")] * 3 + [float("inf")] + list(np.random.default_rng(1).normal(size=9000)),
    "mostly infinite": [float("-inf")] * 6000 + [1.0] * 3000 + [float("inf")] * 6000,
    "overflowing": [1.7e308 * (k / 4500 - 1) for k in range(9001)],
    "all magnitudes": [s * 10.0**k for s in (-1, 1) for k in range(-320, 308) for _ in range(8)],
    "neighbours": [1e300 * (1 + k * 2.0**-52) for k in range(9000)] + [1.0],
    "denormal": [k * 5e-324 for k in range(9000)],
    "zeros": [0.0] * 5000 + [-0.0] * 5000 + [5e-324],
}


def plain_quantile(values, p):
    x = sorted(values)
    k = p * (len(x) - 1)
    a, b = x[math.floor(k)], x[math.ceil(k)]
    part = k - math.floor(k)
    if part == 0 or a == b:
        return a
    return a + (b - a) * part if math.isfinite(b - a) else a * (1 - part) + b * part


@pytest.mark.parametrize("name", HARD)
def test_quantiles_of_hard_values(spark, name):
    """Both versions end, within their bound on passes; NaN and nulls are left out."""
    from chainloom.functions.quantiles import grouped_quantiles

    values, ps = HARD[name], [0, 0.1, 0.25, 0.5, 0.77, 1]
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),)] * 5 + [(None,)], "v double").repartition(3)
    want = [plain_quantile(values, p) for p in ps]
    assert exact_quantiles(df, F.col("v"), ps) == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)
    both = df.select("v", F.lit("a").alias("k")).unionByName(df.select((-F.col("v")).alias("v"), F.lit(None).cast("string").alias("k")))
    got = {r.k: (r.n, r.quantiles) for r in grouped_quantiles(both, ["k"], "v", ps).collect()}
    assert got["a"][0] == len(values) and got["a"][1] == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)
    assert got[None][1] == pytest.approx([plain_quantile([-v for v in values], p) for p in ps], rel=1e-12, abs=0, nan_ok=True)


def test_weighted_order_statistics(spark):
    from chainloom.functions.quantiles import grouped_order_statistics

    r = np.random.default_rng(3)
    rows = [(int(g), float(v), int(w)) for g, v, w in zip(r.integers(0, 3, 6000), r.normal(size=6000).round(2), r.integers(0, 9, 6000))]
    df = spark.createDataFrame([*rows, (0, 1.0, None)], "g int, v double, w long")
    ranks = lambda n: F.array(*[F.floor((n - 1) * p).cast("long") for p in (0.0, 0.3, 0.5, 1.0)])
    for row in grouped_order_statistics(df, ["g"], "v", ranks, "w").collect():
        copies = sorted(v for g, v, w in rows if g == row.g for _ in range(w))
        assert row.n == len(copies) and row.x == [copies[int((len(copies) - 1) * p)] for p in (0.0, 0.3, 0.5, 1.0)]


def test_histogram_rules_leave_out_what_is_not_finite(spark):
    values = [float(k % 7) for k in range(100)]
    clean = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    more = spark.createDataFrame([("a", v) for v in (float("inf"), float("-inf"), float("nan"), None)], "k string, v double")
    for find in (metrics.bin_rules, lambda df, by, v: metrics.histogram_mode(df, by, v, 7)):
        assert find(clean.unionByName(more), ["k"], "v").collect() == find(clean, ["k"], "v").collect()


def test_legendre_polynomials_of_high_degree(spark):
    v = np.linspace(-1, 1, 9)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for degree in (0, 1, 5, 7, 25):
        want = np.polynomial.legendre.Legendre.basis(degree)(v)
        got = df.select(encodings.legendre_polynomial(F.col("v"), degree).alias("p")).toPandas()["p"]
        assert np.allclose(got, want, atol=1e-12)


def test_ids_of_lines_don_t_depend_on_splits(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"{k % 2} {k % 7} 0.5\n" for k in range(200)))
    whole = text.read_labelled(spark, str(tmp_path / "in.txt"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        split = text.read_labelled(spark, str(tmp_path / "in.txt"))
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
        assert whole.select("series_id").distinct().count() == 200
        assert text.read_labelled(spark, str(tmp_path / "in.txt"), stable=False).select("series_id").distinct().count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
