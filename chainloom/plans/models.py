"""Queries on overlaps, chains, metrics, forecasts and searches."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainloom.functions import encodings as E, fitted
from chainloom.functions.scaling import scaled
from chainloom.operators import analysis, contraction, metrics, mps, overlap, prediction, ranges, sampling, search, series as S, training
from chainloom.plans.common import CELLS, embeddings, ranged, six, table
from chainloom.plans.encoding import balanced_edges

#: A real chain of bond 2 for half-angle states: [l][s][r].
TENSOR = (((0.9, 0.1), (0.4, -0.3)), ((-0.2, 0.8), (0.3, 0.7)))


def _unit(spark, d):
    return scaled(embeddings(spark, d))[0]


def _queries(s):
    """The stated query set: every series whose id is divisible by 20."""
    return s.filter(F.col("series_id") % 20 == 0)


def _places(x, n):
    """An array rounded as SQL does."""
    return np.rint(x * 10.0**n) / 10.0**n + 0.0


def overlap_matrix(spark, d):
    s = _unit(spark, d)
    return overlap.overlaps(s, _queries(s), overlap.log_overlap, name="log_overlap", of=lambda o: _places(o, 5))


def rlf_kernel(spark, d):
    """By sums of logarithms: the products of 64 factors stay in range."""
    s = _unit(spark, d)
    return overlap.overlaps(s, _queries(s), overlap.log_overlap, name="rlf", of=lambda o: _places(np.exp(o / math.log(10) * math.log(2.0)), 8))


def nearest_by_overlap(spark, d):
    s = _unit(spark, d)
    found = overlap.nearest(s, _queries(s), overlap.log_overlap)
    return found.select("query_id", "nearest_id", F.round("overlap", 5).alias("log_overlap"))


def mps_score_hof(spark, d):
    s = _unit(spark, d)
    phi = F.transform("x", lambda v: F.array(F.cos(v * (math.pi / 2)), F.sin(v * (math.pi / 2))))
    return s.select("series_id", F.posexplode(contraction.fold_chain(phi, TENSOR)).alias("c", "amplitude")).withColumn("amplitude", F.round("amplitude", 9) + 0.0)


def mps_score_coo(spark, d):
    """The same amplitudes by joins and sums: neighbouring sites are contracted in pairs, so a chain
    of n sites takes log2(n) rounds."""
    s = _unit(spark, d)
    long = contraction.dealt(s).select("series_id", F.posexplode("x").alias("t", "v"))
    local = long.select("series_id", "t", F.posexplode(F.array(F.cos(F.col("v") * (math.pi / 2)), F.sin(F.col("v") * (math.pi / 2)))).alias("s", "v"))
    w = spark.createDataFrame([(i, k, j, float(TENSOR[i][k][j])) for i in range(2) for k in range(2) for j in range(2)], "l int, s int, r int, v double")
    sites = contraction.contract(local, F.broadcast(w)).select("series_id", "t", "l", "r", F.lit(None).cast("int").alias("c"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    state = contraction.pairs_contracted(sites, _length(s))
    return state.filter("l = 0").select("series_id", F.col("r").alias("c"), (F.round("re", 9) + 0.0).alias("amplitude"))


def _length(s) -> int:
    return s.select(F.size("x").alias("n")).first().n


def _n_classes(s) -> int:
    return s.agg(F.max("label").cast("int").alias("c")).first().c + 1


def _chain_of(length, n_classes):
    """The literal chain of any length; its last bond is read along one direction of the half plane for each class."""
    t = np.array(TENSOR)
    turn = np.pi * np.arange(n_classes) / n_classes
    return mps.Chain((t[:1], *[t] * (length - 2), np.einsum("lsr,rc->lsc", t, [np.cos(turn), np.sin(turn)])[:, :, None]), length - 1)


def _scored(spark, d):
    s = _unit(spark, d)
    return prediction.scores(s, _chain_of(_length(s), _n_classes(s)), "half_angle", 2)


#: A real chain of bond 2 for two bins of half-angle states: [l][s][r].
SPLIT_TENSOR = (((0.9, 0.1), (0.4, -0.3), (0.7, 0.2), (-0.5, 0.6)), ((-0.2, 0.8), (0.3, 0.7), (0.6, -0.4), (0.1, 0.9)))


def mps_split_score(spark, d):
    """Logarithms of the amplitudes of a chain that carries its fitted encoding, ``hist split balanced half_angle``."""
    s = _unit(spark, d)
    found, length = fitted.fitted(s, "hist split balanced half_angle", 4), _length(s)
    t = np.array(SPLIT_TENSOR)
    chain = mps.Chain((t[:1], *[t] * (length - 2), t[:, :, :1, None]), length - 1, found)
    return prediction.scores(s, chain).select("series_id", F.round(F.log(F.col("weight")[0]) / 2, 6).alias("log_amplitude"))


def mps_predict(spark, d):
    return prediction.predictions(_scored(spark, d)).select("series_id", "label", "predicted")


def mps_output_range(spark, d):
    """Logarithms of the least and greatest norm of the literal chain's outputs, by a contraction that can't leave range."""
    s = _unit(spark, d)
    found = ranges.output_range(ranges.log_scores(s, _chain_of(_length(s), _n_classes(s)), "half_angle", 2))
    return found.select(six(F.col("least")).alias("least"), six(F.col("greatest")).alias("greatest"), "n", "n_zero")


def mps_check_routes(spark, d):
    """Where arrays and joins disagree on the literal chain, if the entries of class 1 at the end are half as large again in one of them."""
    s = _unit(spark, d)
    length = _length(s)
    chain = _chain_of(length, _n_classes(s))
    entries = mps.model_table(spark, chain, "literal").withColumn("re", F.when((F.col("site") == length - 1) & (F.col("c") == 1), F.col("re") * 1.5).otherwise(F.col("re")))
    local = E.encoded(contraction.dealt(s), "half_angle", 2)
    found = contraction.disagreeing(prediction.scores(s, chain, "half_angle", 2), contraction.relational_amplitudes(local, entries, length))
    return found.select("series_id", "c", F.round(F.log("weight"), 5).alias("log_weight"), F.round(F.log("relational"), 5).alias("log_relational"))


def mps_confusion(spark, d):
    return metrics.confusion(mps_predict(spark, d), "label", "predicted")


def mps_metrics(spark, d):
    """Each class against all others."""
    counts = mps_confusion(spark, d)
    each = counts.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(_n_classes(_unit(spark, d)) - 1))))
    return metrics.binary_scores(each, F.col("truth") == F.col("class"), F.col("predicted") == F.col("class"), by=("class",), times="n").select("class", *[six(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy")])


def mps_kld(spark, d):
    return prediction.summary(_scored(spark, d)).select(six(F.col("kld")).alias("kld"), six(F.col("mse")).alias("mse"), "n")


def mps_overlap_statistics(spark, d):
    found = prediction.overlap_statistics(_scored(spark, d))
    return found.select("label", "model", *[six(F.col(c)).alias(c) for c in ("median", "least", "greatest")])


def label_metrics(spark, d):
    """Toxicity taken as a forecast of quality: the counts of a binary pair."""
    found = metrics.binary_scores(table(spark, d, "labels"), "quality", "toxic")
    return found.select(*[six(F.col(c)).alias(c) for c in found.columns])


def _daily(spark, d):
    """Daily means of order prices by priority, each with the value of the day before as forecast."""
    orders = table(spark, d, "orders")
    daily = orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("actual"))
    w = Window.partitionBy("o_orderpriority").orderBy("day")
    return daily.withColumn("forecast", F.lag("actual").over(w)).withColumn("t", F.row_number().over(w))


def forecast_errors(spark, d):
    found = metrics.forecast_errors(_daily(spark, d).filter("forecast IS NOT NULL"), ["o_orderpriority"])
    return found.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


def _mase(season):
    def query(spark, d):
        days = _daily(spark, d)
        train, test = days.filter("t <= 200"), days.filter("t > 200")
        scale = metrics.naive_scale(train, ["o_orderpriority"], "t", "actual", season)
        error = test.groupBy("o_orderpriority").agg(metrics.mae(F.col("actual"), F.col("forecast")).alias("mae"))
        return error.join(scale, "o_orderpriority").select("o_orderpriority", six(F.col("mae") / F.col("scale")).alias("mase"))

    return query


def traj_mean_std(spark, d):
    long = S.long_form(embeddings(spark, d))
    return long.groupBy("label", "t").agg(six(F.avg("v")).alias("mean"), six(F.stddev_samp("v")).alias("deviation"))


def hist_bin_rules(spark, d):
    return metrics.bin_rules(table(spark, d, "events"), ["event_type"], "value")


def hist_mode(spark, d):
    found = metrics.histogram_mode(table(spark, d, "events"), ["event_type"], "value", 12)
    return found.select("event_type", six(F.col("mode")).alias("mode"))


def grid_minus_done(spark, d):
    cells = search.grid(spark, 2, [0.05, 0.1], [2, 3, 4], [10, 20], ["stoudenmire", "fourier", "sahand"], most=60)
    done = cells.filter("fold = 1 AND rate = 0.05")
    return search.remaining(cells, done)


_chains: WeakKeyDictionary = WeakKeyDictionary()  # by session, then by the input's files: what several queries start from


def _files(spark, d) -> tuple:
    """Names, sizes and times of the files of the series table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/embeddings.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _trained(spark, d):
    """A chain of all time points with a class axis of all labels, trained on all series; once for a session and state of the table."""
    known, key = _chains.setdefault(spark, {}), _files(spark, d)
    if key not in known:
        known[key] = _train(spark, d)
    return known[key]


def _train(spark, d):
    s = S.spread(_unit(spark, d))
    options = training.Options(sweeps=1, max_bond=4, first_bond=2, rate=0.1)
    return training.fit(s, None, options)


def mps_train(spark, d):
    known, found = _chains.setdefault(spark, {}), _train(spark, d)
    log = known.setdefault(_files(spark, d), found)[1]
    rows = [(x["sweep"], x["train_accuracy"], x["train_kld"], x["train_mse"]) for x in log]
    return spark.createDataFrame(rows, "sweep int, accuracy double, kld double, mse double")


def mps_model_table(spark, d):
    return mps.model_table(spark, _trained(spark, d)[0], "all_classes")


def _class_states(spark, d):
    chain = _trained(spark, d)[0]
    return [mps.right_orthogonal(chain.of_class(c)) for c in range(chain.n_classes)]


def _drawn(spark, d, sites, shots, method="grid"):
    """Draws for every series from the state of its own class, in one pass; sites below 0 count from the end."""
    s, found = S.spread(_unit(spark, d)), _class_states(spark, d)
    length = len(found[0])
    return s, sampling.draws(s, found, "stoudenmire", 2, [t % length for t in sites], shots, method=method)


def mps_forecast(spark, d):
    s, found = _drawn(spark, d, [-3, -2, -1], 20)
    n = len(_class_states(spark, d)[0])
    return sampling.trajectory(found).drop("label").join(sampling.truth_of(s, [n - 3, n - 2, n - 1]), ["series_id", "t"])


def mps_forecast_errors(spark, d):
    return metrics.forecast_errors(mps_forecast(spark, d), ["t"], "actual", "mean")


def mps_interpolate(spark, d):
    return sampling.trajectory(_drawn(spark, d, [2, 3, 5], 20)[1]).drop("label")


def mps_forecast_exact(spark, d):
    """Draws by the exact inverse of the distribution function."""
    return sampling.trajectory(_drawn(spark, d, [-3, -2, -1], 20, "exact")[1]).drop("label")


def mps_forecast_mode(spark, d):
    return sampling.bootstrapped_mode(_drawn(spark, d, [-2, -1], 40)[1], 100)


def encoding_bias(spark, d):
    """How far the mean of the density that a half-angle state implies is from the value itself, in ten bins of the range."""
    found = sampling.bias_by_bin(sampling.encoding_bias(_unit(spark, d), "half_angle", 2), 0.0, 1.0, 10)
    return found.select("bin", "n", six(F.col("bias")).alias("bias"), six(F.col("size")).alias("size"))


def mps_marginals(spark, d):
    found = [sampling.marginals(spark, state, "stoudenmire", 2).withColumn("class", F.lit(c)) for c, state in enumerate(_class_states(spark, d))]
    return reduce(lambda a, b: a.unionByName(b), found)


def entropy_profile(spark, d):
    rows = [(c, j, e) for c, state in enumerate(_class_states(spark, d)) for j, e in enumerate(mps.entropy_profile(state))]
    return spark.createDataFrame(rows, "class int, cut int, entropy double")


def two_point_correlation(spark, d):
    rows = [(c, i, j, float(v)) for c, state in enumerate(_class_states(spark, d)) for (i, j), v in np.ndenumerate(mps.two_point(state))]
    return spark.createDataFrame(rows, "class int, i int, j int, correlation double")


def class_state_overlaps(spark, d):
    """Of all pairs of class states, and of each state with what is left of each other one beside it."""
    states = _class_states(spark, d)
    rows = [(f"{i},{j}", abs(mps.inner(states[i], states[j]))) for i in range(len(states)) for j in range(i, len(states))]
    rows += [(f"{i},rest of {j}", abs(mps.inner(states[i], mps.difference(states[i], states[j])))) for i in range(len(states)) for j in range(len(states)) if i != j]
    return spark.createDataFrame(rows, "pair string, overlap double")


def effective_overlap(spark, d):
    """Every series against every class state."""
    return analysis.effective_overlaps(_unit(spark, d), _class_states(spark, d), "stoudenmire", 2)


def entropy_variation(spark, d):
    """Class means of the variation, by site; every series in the state of its own class."""
    found = analysis.entropy_variations(S.spread(_unit(spark, d)), _class_states(spark, d), "stoudenmire", 2)
    return found.groupBy("label", "t").agg(F.avg("variation").alias("variation"))


def kernel_embedding(spark, d):
    """Every series, placed by 128 landmarks that a hash chooses."""
    s = _unit(spark, d)
    landmarks = s.orderBy(F.xxhash64(F.lit(9), "series_id"), "series_id").limit(128)
    return analysis.embedded(overlap.overlaps(s, landmarks))


def basis_projection(spark, d):
    s = scaled(embeddings(spark, d), to=(-1.0, 1.0))[0]
    fourier = analysis.projected_basis(s, "fourier", 4).withColumn("kind", F.lit("fourier"))
    found = fourier.unionByName(analysis.projected_basis(s, "legendre", 4, terms=12).withColumn("kind", F.lit("legendre")))
    return found.select("kind", "t", "place", "term", six(F.col("weight")).alias("weight"))


def site_overlap(spark, d):
    """Every series against the class states of the literal chain, site by site: the mean one-site overlap."""
    s = _unit(spark, d)
    n = _n_classes(s)
    chain = _chain_of(_length(s), n)
    found = analysis.effective_overlaps(s, [chain.of_class(c) for c in range(n)], "half_angle", 2)
    return found.select("series_id", "class", six(F.col("overlap")).alias("overlap"))


def mps_sum_state(spark, d):
    """How far the superposition of 8 series of each class already tells the classes apart."""
    s = _unit(spark, d)
    start = training.sum_state_start(s, training.Options(first_bond=6))
    return prediction.summary(prediction.scores(s, start, "stoudenmire", 2))


def mps_generative(spark, d):
    """Each class alone, trained on the likelihood with its partition function."""
    s = _unit(spark, d)
    options = training.Options(sweeps=1, max_bond=3, first_bond=2, partition=True, rescale=False)

    def log_of(c):
        return training.fit(s.filter(F.col("label") == c).withColumn("label", F.lit(0)), None, options)[1]

    classes = range(_n_classes(s))
    with ThreadPoolExecutor(4) as pool:  # the driver waits for small jobs most of the time
        rows = [(c, x["sweep"], x["train_kld"]) for c, log in zip(classes, pool.map(log_of, classes)) for x in log]
    return spark.createDataFrame(rows, "class int, sweep int, nll double")


NAMES = [
    "effective_overlap", "entropy_variation", "kernel_embedding", "basis_projection", "mps_sum_state", "mps_generative",
    "encoding_bias", "site_overlap", "mps_check_routes", "mps_forecast_exact", "mps_output_range", "mps_split_score", "overlap_matrix", "rlf_kernel", "nearest_by_overlap", "mps_score_hof", "mps_score_coo", "mps_predict", "mps_confusion", "mps_metrics", "mps_kld",
    "mps_overlap_statistics", "label_metrics", "forecast_errors", "traj_mean_std", "hist_bin_rules", "hist_mode", "grid_minus_done", "mps_train", "mps_model_table",
    "mps_forecast", "mps_forecast_errors", "mps_interpolate", "mps_forecast_mode", "mps_marginals", "entropy_profile", "two_point_correlation", "class_state_overlaps",
]
QUERIES = {n: globals()[n] for n in NAMES} | {"fc_mase_1": _mase(1), "fc_mase_7": _mase(7)}



def _chain_sql() -> str:
    """WITH ``last``: amplitudes (a0, a1) of each series after all sites; ``weights``: the squared ones of each class; ``predicted``."""
    w = TENSOR
    step = [" + ".join(f"{a} * (CAST({w[i][0][r]} AS DOUBLE) * cos(pi() / 2 * v) + CAST({w[i][1][r]} AS DOUBLE) * sin(pi() / 2 * v))" for i, a in ((0, "a0"), (1, "a1"))) for r in range(2)]
    return f"""WITH RECURSIVE {ranged(0.0, 1.0)}, held AS MATERIALIZED (SELECT * FROM z), chain AS (
  SELECT DISTINCT series_id, label, 0 AS t, CAST(1 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1 FROM held
  UNION ALL
  SELECT c.series_id, c.label, c.t + 1, {step[0]}, {step[1]} FROM chain c JOIN held ON held.series_id = c.series_id AND held.t = c.t
), last AS MATERIALIZED (SELECT series_id, label, a0, a1 FROM chain WHERE t = (SELECT max(t) + 1 FROM held)),
classes AS (SELECT CAST(unnest(range(max(label) + 1)) AS INTEGER) AS c, max(label) + 1 AS n FROM last),
weights AS MATERIALIZED (SELECT series_id, label, c, pow(a0 * cos(pi() * c / n) + a1 * sin(pi() * c / n), 2) AS w FROM last, classes),
predicted AS (SELECT series_id, label, c AS predicted FROM weights QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY w DESC, c) = 1)"""


def _basis_sql() -> str:
    """The terms of greatest squared coefficient of the root of each time point's density, on a grid of 200 points of [-1, 1]."""
    terms = [("fourier", (k + 1) // 2 * (1 if k % 2 else -1), k) for k in range(40)] + [("legendre", k, k) for k in range(12)]
    return f"""WITH RECURSIVE {ranged(-1.0, 1.0)}, counts AS MATERIALIZED (SELECT t, floor(v * 256) AS b, count(*) AS n, avg(v) AS m FROM z GROUP BY ALL),
points AS (SELECT g, -1.0::DOUBLE + g * (2.0::DOUBLE / 199) AS x, CASE WHEN g IN (0, 199) THEN 1.0::DOUBLE / 199 ELSE 2.0::DOUBLE / 199 END AS w FROM range(200) AS r(g)),
density AS MATERIALIZED (SELECT t, g, x, w, sqrt(sum(n * exp(-0.5::DOUBLE * pow((x - m) / 0.8::DOUBLE, 2))) / (sum(n) * 0.8::DOUBLE * sqrt(2 * pi()))) AS y FROM counts, points GROUP BY ALL),
legendre AS (SELECT g, x, 0 AS n, 1.0::DOUBLE AS p, 0.0::DOUBLE AS before FROM points UNION ALL
  SELECT g, x, n + 1, ((2 * n + 1) * x * p - n * before) / (n + 1), p FROM legendre WHERE n < 11),
terms(kind, term, i) AS (VALUES {", ".join(map(str, terms))}),
f AS (SELECT kind, term, i, points.g, CASE kind WHEN 'fourier' THEN cos(pi() * term * points.x) ELSE p * sqrt((2 * term + 1) / 2.0::DOUBLE) END AS re, CASE kind WHEN 'fourier' THEN -sin(pi() * term * points.x) ELSE 0 END AS im
  FROM terms JOIN points ON true LEFT JOIN legendre ON kind = 'legendre' AND legendre.n = term AND legendre.g = points.g),
c AS (SELECT kind, t, term, i, round(pow(sum(y * w * re), 2) + pow(sum(y * w * im), 2), 12) AS weight FROM density JOIN f USING (g) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, t ORDER BY weight DESC, i) - 1 AS place FROM c)
SELECT kind, t, CAST(place AS INTEGER) AS place, term, round(weight, 6) + 0.0 AS weight FROM r WHERE place < 4"""


def _site_overlap_sql() -> str:
    """One-site densities of the literal chain's class states, from environments of trace 1 on both sides, and their mean overlaps."""
    w = TENSOR
    number = lambda i, s, r: f"CAST({w[i][s][r]} AS DOUBLE)"
    # environments are symmetric 2 x 2 matrices: e0, e1 (twice beside the diagonal), e2
    e = lambda i, k: f"e{i + k}"
    left = [" + ".join(f"{number(i, s, r)} * {e(i, k)} * {number(k, s, q)}" for s in (0, 1) for i in (0, 1) for k in (0, 1)) for r, q in ((0, 0), (0, 1), (1, 1))]
    right = [" + ".join(f"{number(i, s, r)} * {e(r, q)} * {number(k, s, q)}" for s in (0, 1) for r in (0, 1) for q in (0, 1)) for i, k in ((0, 0), (0, 1), (1, 1))]
    rho = [" + ".join(f"l{i + k} * {number(i, s, r)} * r{r + q} * {number(k, u, q)}" for i in (0, 1) for k in (0, 1) for r in (0, 1) for q in (0, 1)) for s, u in ((0, 0), (0, 1), (1, 1))]
    unit = lambda parts: ", ".join(f"({p}) / (({parts[0]}) + ({parts[2]}))" for p in parts)
    return f"""WITH RECURSIVE {ranged(0.0, 1.0)}, n AS (SELECT max(t) AS last, max(label) + 1 AS classes FROM z),
lefts AS (SELECT 0 AS t, 1.0::DOUBLE AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2 UNION ALL SELECT t + 1, {unit(left)} FROM lefts, n WHERE t < last),
rights AS (SELECT c, last AS t, pow(cos(pi() * c / classes), 2) AS e0, cos(pi() * c / classes) * sin(pi() * c / classes) AS e1, pow(sin(pi() * c / classes), 2) AS e2 FROM n, range(classes) AS r(c)
  UNION ALL SELECT c, t - 1, {unit(right)} FROM rights WHERE t > 0),
both_sides AS (SELECT c, t, a.e0 AS l0, a.e1 AS l1, a.e2 AS l2, b.e0 AS r0, b.e1 AS r1, b.e2 AS r2 FROM lefts a JOIN rights b USING (t)),
rho AS MATERIALIZED (SELECT c, t, {rho[0]} AS p, {rho[1]} AS q, {rho[2]} AS s FROM both_sides)
SELECT series_id, CAST(c AS INTEGER) AS class, round(avg((p * pow(cos(pi() / 2 * v), 2) + 2 * q * cos(pi() / 2 * v) * sin(pi() / 2 * v) + s * pow(sin(pi() / 2 * v), 2)) / (p + s)), 6) + 0.0 AS overlap
FROM z JOIN rho USING (t) GROUP BY series_id, c"""


def _split_sql() -> str:
    """The amplitude of each series under ``SPLIT_TENSOR``: states of two bins by balanced edges, then the chain site by site."""
    w = SPLIT_TENSOR
    half = [f"{f}(pi() / 2 * u{b}) * w{b}" for b in (0, 1) for f in ("cos", "sin")]
    step = [" + ".join(f"{a} * CAST({w[i][k][r]} AS DOUBLE) * p{k}" for i, a in ((0, "a0"), (1, "a1")) for k in range(4)) for r in range(2)]
    rect = "CASE WHEN u{0} IS NULL THEN 0 WHEN abs(u{0} - 0.5) = 0.5 THEN 0.5 WHEN abs(u{0} - 0.5) < 0.5 THEN 1 ELSE 0 END AS w{0}"
    return f"""WITH RECURSIVE {ranged(0.0, 1.0)}{balanced_edges(2)}, u AS (
  SELECT series_id, z.t, CASE WHEN m.edge > 0 THEN v / m.edge END AS u0, CASE WHEN m.edge < 1 THEN (v - m.edge) / (1 - m.edge) END AS u1 FROM z JOIN edges m ON m.t = z.t AND m.k = 1
), r AS (SELECT *, {rect.format(0)}, {rect.format(1)} FROM u),
p AS MATERIALIZED (SELECT series_id, t, {", ".join(f"CASE WHEN w{k // 2} = 0 THEN 0 ELSE {h} END AS p{k}" for k, h in enumerate(half))} FROM r),
chain AS (
  SELECT DISTINCT series_id, 0 AS t, CAST(1 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1 FROM p
  UNION ALL SELECT c.series_id, c.t + 1, {step[0]}, {step[1]} FROM chain c JOIN p ON p.series_id = c.series_id AND p.t = c.t
) SELECT series_id, round(ln(abs(a0)), 6) AS log_amplitude FROM chain WHERE t = (SELECT max(t) + 1 FROM p)"""


_AMPLITUDES = " SELECT series_id, 0 AS c, round(a0, 9) + 0.0 AS amplitude FROM last UNION ALL SELECT series_id, 1, round(a1, 9) + 0.0 FROM last"
_RATES = """round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, round(tp / nullif(tp + fp, 0), 6) + 0.0 AS precision, round(tp / nullif(tp + fn, 0), 6) + 0.0 AS recall,
  round(tn / nullif(tn + fp, 0), 6) + 0.0 AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) + 0.0 AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) + 0.0 AS balanced_accuracy"""
_SCORES = """SELECT round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall,
  round(tn / (tn + fp), 6) + 0.0 AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0.0 AS balanced_accuracy
  FROM (SELECT CAST(count(*) FILTER ({t} <> 0 AND {p} <> 0) AS DOUBLE) AS tp, CAST(count(*) FILTER ({t} = 0 AND {p} <> 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER ({t} <> 0 AND {p} = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER ({t} = 0 AND {p} = 0) AS DOUBLE) AS tn FROM {f})"""
_DAILY = """WITH a AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS actual FROM orders GROUP BY ALL),
d AS (SELECT *, lag(actual) OVER (PARTITION BY o_orderpriority ORDER BY day) AS forecast, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS t FROM a)"""


def _mase_sql(m):
    return _DAILY + f""", s AS (SELECT o_orderpriority, avg(x) AS scale FROM (SELECT o_orderpriority, abs(actual - lag(actual, {m}) OVER (PARTITION BY o_orderpriority ORDER BY t)) AS x FROM d WHERE t <= 200) GROUP BY ALL)
SELECT o_orderpriority, round(avg(abs(actual - forecast)) / any_value(scale), 6) + 0.0 AS mase FROM d JOIN s USING (o_orderpriority) WHERE t > 200 GROUP BY o_orderpriority"""


_PAIRS = """SELECT a.series_id AS query_id, b.series_id AS series_id, a.t, a.v AS qv, b.v AS v FROM z a JOIN z b ON a.t = b.t WHERE a.series_id % 20 = 0"""
ORACLE_SQL = {
    "overlap_matrix": f"WITH {ranged(0.0, 1.0)} SELECT query_id, series_id, round(sum(ln(abs(cos(pi() / 2 * (qv - v))))), 5) AS log_overlap FROM ({_PAIRS}) GROUP BY query_id, series_id",
    "rlf_kernel": f"WITH {ranged(0.0, 1.0)} SELECT query_id, series_id, round(pow(2.0::DOUBLE, sum(ln(abs(cos(pi() / 2 * (qv - v))))) / ln(10)), 8) + 0.0 AS rlf FROM ({_PAIRS}) GROUP BY query_id, series_id",
    "nearest_by_overlap": f"""WITH {ranged(0.0, 1.0)}, o AS (SELECT query_id, series_id, sum(ln(abs(cos(pi() / 2 * (qv - v))))) AS o FROM ({_PAIRS}) WHERE query_id <> series_id GROUP BY query_id, series_id)
SELECT query_id, series_id AS nearest_id, round(o, 5) AS log_overlap FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o DESC, series_id) = 1""",
    "encoding_bias": f"""WITH {ranged(0.0, 1.0)}, m AS (SELECT v, (0.25 + (sin(pi() * v) / pi() - 2 * cos(pi() * v) / (pi() * pi())) / 2) / (0.5 + sin(pi() * v) / pi()) - v AS gap FROM z)
SELECT least(floor(v * 10), 9)::INT AS bin, count(*) AS n, round(avg(gap), 6) + 0.0 AS bias, round(avg(abs(gap)), 6) + 0.0 AS size FROM m GROUP BY ALL""",
    "mps_output_range": _chain_sql() + """, norms AS (SELECT ln(sum(w)) / 2 AS n FROM weights GROUP BY series_id)
      SELECT round(min(n), 6) + 0.0 AS least, round(max(n), 6) + 0.0 AS greatest, count(*) AS n, CAST(0 AS BIGINT) AS n_zero FROM norms""",
    "mps_check_routes": _chain_sql() + " SELECT series_id, c, round(ln(w), 5) AS log_weight, round(ln(2.25::DOUBLE * w), 5) AS log_relational FROM weights WHERE c = 1",
    "basis_projection": _basis_sql(),
    "site_overlap": _site_overlap_sql(),
    "mps_split_score": _split_sql(),
    "mps_score_hof": _chain_sql() + _AMPLITUDES,
    "mps_score_coo": _chain_sql() + _AMPLITUDES,
    "mps_predict": _chain_sql() + " SELECT series_id, label, predicted FROM predicted",
    "mps_confusion": _chain_sql() + """, cs AS (SELECT label AS c FROM predicted UNION SELECT predicted FROM predicted)
      SELECT a.c AS truth, b.c AS predicted, count(p.series_id) AS n FROM cs a CROSS JOIN cs b LEFT JOIN predicted p ON p.label = a.c AND p.predicted = b.c GROUP BY a.c, b.c""",
    "mps_metrics": _chain_sql() + f""", counts AS (
        SELECT c AS class, CAST(count(*) FILTER (label = c AND predicted = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (label <> c AND predicted = c) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (label = c AND predicted <> c) AS DOUBLE) AS fn, CAST(count(*) FILTER (label <> c AND predicted <> c) AS DOUBLE) AS tn
        FROM predicted, classes GROUP BY c) SELECT class, {_RATES} FROM counts""",
    "mps_kld": _chain_sql() + """, errors AS (SELECT series_id, sum(pow(sqrt(w) - (c = label)::INT, 2)) / 2 AS e, sum(CASE WHEN c = label THEN -ln(w) END) AS k FROM weights GROUP BY series_id)
      SELECT round(avg(k), 6) + 0.0 AS kld, round(avg(e), 6) + 0.0 AS mse, count(*) AS n FROM errors""",
    "mps_overlap_statistics": _chain_sql() + """
      SELECT label, c AS model, round(median(sqrt(w)), 6) + 0.0 AS median, round(min(sqrt(w)), 6) + 0.0 AS least, round(max(sqrt(w)), 6) + 0.0 AS greatest FROM weights GROUP BY label, c""",
    "label_metrics": _SCORES.format(t="quality", p="toxic", f="labels"),
    "forecast_errors": _DAILY + """ SELECT o_orderpriority, round(avg(abs(actual - forecast) / abs(actual)), 4) AS mape, round(avg(abs(actual - forecast) / ((abs(actual) + abs(forecast)) / 2)), 4) AS smape,
      round(avg((actual - forecast) * (actual - forecast)), 4) AS mse, round(avg(abs(actual - forecast)), 4) AS mae, round(sqrt(avg((actual - forecast) * (actual - forecast))), 4) AS rmse FROM d WHERE forecast IS NOT NULL GROUP BY o_orderpriority""",
    "fc_mase_1": _mase_sql(1),
    "fc_mase_7": _mase_sql(7),
    "traj_mean_std": f"WITH {CELLS} SELECT label, t, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS deviation FROM cells GROUP BY label, t",
    "hist_bin_rules": """SELECT event_type, CAST(ceil(log2(n) + 1) AS BIGINT) AS sturges, CAST(ceil((hi - lo) / (3.5 * s * pow(n, -1 / 3.0::DOUBLE))) AS BIGINT) AS scott,
      CAST(ceil((hi - lo) / (2 * (q3 - q1) * pow(n, -1 / 3.0::DOUBLE))) AS BIGINT) AS freedman_diaconis, CAST(ceil(sqrt(n)) AS BIGINT) AS square_root
      FROM (SELECT event_type, count(value)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)""",
    "hist_mode": """WITH x AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
b AS (SELECT event_type, lo, hi, least(floor((value - lo) * 12 / (hi - lo)), 11) AS b, count(*) AS n FROM events JOIN x USING (event_type) GROUP BY ALL)
SELECT event_type, round(lo + (hi - lo) * (0.5 + b) / 12, 6) + 0.0 AS mode FROM b QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, b) = 1""",
    "grid_minus_done": """SELECT CAST(f AS INTEGER) AS fold, r::DOUBLE AS rate, CAST(d AS INTEGER) AS d, CAST(b AS INTEGER) AS max_bond, e AS encoding
FROM (VALUES (1), (2)) a(f), (VALUES (0.05), (0.1)) b(r), (VALUES (2), (3), (4)) c(d), (VALUES (10), (20)) g(b), (VALUES ('stoudenmire'), ('fourier'), ('sahand')) h(e)
WHERE b * d <= 60 AND NOT (e = 'stoudenmire' AND d <> 2) AND NOT (e = 'sahand' AND d % 2 = 1) AND NOT (f = 1 AND r = 0.05)""",
}
