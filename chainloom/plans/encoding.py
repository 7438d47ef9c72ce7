"""Queries on the local feature maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chainloom.functions import encodings as E, fitted
from chainloom.functions.scaling import binarised, letter, scaled, uniform_bin
from chainloom.operators import series as S
from chainloom.plans.common import CELLS, embeddings, ranged, six


def _scaled(spark, d, name):
    e = E.ENCODINGS[name]
    return scaled(embeddings(spark, d), to=(e.low, e.high))[0]


def _encoded(name, dim):
    def query(spark, d):
        z = E.encoded(_scaled(spark, d, name), name, dim)
        return z.select("series_id", "t", "k", six(F.col("re")).alias("re"), six(F.col("im")).alias("im"))

    return query


def split_uniform_edges(spark, d):
    return spark.range(1).select(F.posexplode(E.uniform_edges(4, -1.0, 1.0)).alias("k", "edge")).select("k", six(F.col("edge")).alias("edge"))


def split_hist_edges(spark, d):
    edges = E.histogram_edges(_scaled(spark, d, "half_angle"), 4, 0.0, 1.0)
    return edges.select("t", F.posexplode("edges").alias("k", "edge")).select("t", "k", six(F.col("edge")).alias("edge"))


def _split(series, edges, spark):
    long = series.select("series_id", F.posexplode("x").alias("t", "v"))
    long = long.join(edges, "t") if "t" in edges.columns else long.withColumn("edges", E.uniform_edges(4, 0.0, 1.0))
    parts = E.split_on_edges(F.col("v"), F.col("edges"), 4, E.half_angle, 2)
    z = E.components(long, parts, False)
    return z.groupBy("t", "k").agg(F.count("*").alias("n"), F.round(F.sum("re"), 4).alias("total"), F.sum((F.col("re") != 0).cast("long")).alias("n_used"))


def enc_uniform_split(spark, d):
    return _split(_scaled(spark, d, "half_angle"), spark.range(1), spark)


def enc_hist_split(spark, d):
    s = _scaled(spark, d, "half_angle")
    return _split(s, E.histogram_edges(s, 4, 0.0, 1.0), spark)


def basis_grid(spark, d):
    """The Fourier basis on an even grid of its range."""
    long = spark.range(41).select(F.lit(0).alias("series_id"), F.col("id").cast("int").alias("t"), (F.lit(-1.0) + F.col("id") * F.lit(0.05)).alias("v"))
    z = E.components(long, E.fourier(F.col("v"), 5), True)
    return z.select("t", "k", six(F.col("re")).alias("re"), six(F.col("im")).alias("im"))


def _rows(z):
    return z.select("series_id", "t", "k", six(F.col("re")).alias("re"), six(F.col("im")).alias("im"))


def _lists(spark, make):
    """(t, ks) of the 64 time points."""
    return spark.range(64).select(F.col("id").cast("int").alias("t")).withColumn("ks", make(F.col("t")))


def enc_fourier_by_time(spark, d):
    """Every third time point has frequencies of its own."""
    lists = _lists(spark, lambda t: F.array(F.lit(0), 1 + t % 3, -(1 + t % 3)))
    return _rows(E.by_time(_scaled(spark, d, "fourier"), lists, E.fourier_by_list))


def enc_legendre_by_time(spark, d):
    lists = _lists(spark, lambda t: F.array(t % 2, 2 + t % 2))
    return _rows(E.by_time(_scaled(spark, d, "legendre"), lists, lambda v, ks: E.legendre_by_list(v, ks, 3)))


def enc_letter_states(spark, d):
    """SAX letters of equal width, each as the basis state of its place in the alphabet."""
    long = S.long_form(embeddings(spark, d))
    extent = long.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    symbols = long.join(extent, "t").select("series_id", "t", letter(uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), 4)).alias("symbol"))
    return _rows(E.number_states(symbols, E.letter_number(F.col("symbol")), 4))


def enc_bit_states(spark, d):
    """Bits by the median of each series: 0 is the first basis state, 1 the second."""
    bits = embeddings(spark, d).select("series_id", F.posexplode(binarised(F.col("x"), "median")).alias("t", "b"))
    return _rows(E.number_states(bits, F.col("b"), 2))


def _edge_rows(edges, *by):
    return edges.select(*by, "t", F.posexplode("edges").alias("k", "edge")).withColumn("edge", six(F.col("edge")))


def split_hist_balanced(spark, d):
    """Four bins in which all classes together weigh the same, each class as much as any other."""
    return _edge_rows(fitted.edges_of(_scaled(spark, d, "half_angle"), fitted.parsed("hist split balanced half_angle"), 4, False))


def split_hist_by_class(spark, d):
    return _edge_rows(fitted.edges_of(_scaled(spark, d, "half_angle"), fitted.parsed("hist split half_angle"), 4, True), "label")


KINDS = {
    "enc_stoudenmire": ("stoudenmire", 2), "enc_half_angle": ("half_angle", 2), "enc_qudit": ("qudit", 3), "enc_linear": ("linear", 2), "enc_fourier": ("fourier", 5),
    "enc_sahand": ("sahand", 4), "enc_legendre": ("legendre", 4), "enc_legendre_nonorm": ("legendre_no_norm", 4), "enc_uniform": ("uniform", 3),
}
QUERIES = {n: _encoded(*k) for n, k in KINDS.items()} | {
    "split_uniform_edges": split_uniform_edges, "split_hist_edges": split_hist_edges, "enc_uniform_split": enc_uniform_split, "enc_hist_split": enc_hist_split, "basis_grid": basis_grid,
    "enc_fourier_by_time": enc_fourier_by_time, "enc_legendre_by_time": enc_legendre_by_time, "enc_letter_states": enc_letter_states, "enc_bit_states": enc_bit_states,
    "split_hist_balanced": split_hist_balanced, "split_hist_by_class": split_hist_by_class,
}


def _sql(low, high, parts):
    """Components (re, im) as SQL of v."""
    rows = " UNION ALL ".join(f"SELECT series_id, t, {k} AS k, round({re}, 6) + 0.0 AS re, round({im}, 6) + 0.0 AS im FROM z" for k, (re, im) in enumerate(parts))
    return f"WITH {ranged(low, high)} {rows}"


def _fourier_sql(v, d):
    ks = [0, 1, -1, 2, -2][:d]
    return [(f"cos(pi() * {k} * {v}) / sqrt({d})", f"sin(pi() * {k} * {v}) / sqrt({d})") for k in ks]


def _sahand_sql(d):
    w, parts = 2 / d, []
    for m in range(d // 2):
        inside = f"v >= CAST({m * w} AS DOUBLE) AND v <= CAST({m * w + w} AS DOUBLE)"
        for f, sign in (("cos", 1), ("sin", -1)):
            size, turn = f"{f}(pi() / 2 * (v - CAST({m * w} AS DOUBLE)) / CAST({w} AS DOUBLE))", f"(1.5 * pi() * v / CAST({w} AS DOUBLE))"
            parts.append((f"CASE WHEN {inside} THEN {size} * cos{turn} ELSE 0 END", f"CASE WHEN {inside} THEN {sign} * {size} * sin{turn} ELSE 0 END"))
    return parts


_P = ["1.0::DOUBLE", "v", "(3 * v * v - 1) / 2", "(5 * v * v * v - 3 * v) / 2"]
_LEGENDRE = [f"sqrt({2 * n + 1} / 2.0::DOUBLE) * ({p})" for n, p in enumerate(_P)]
_ANGLE = [("cos(pi() / 2 * v) * cos(1.5 * pi() * v)", "cos(pi() / 2 * v) * sin(1.5 * pi() * v)"), ("sin(pi() / 2 * v) * cos(1.5 * pi() * v)", "-sin(pi() / 2 * v) * sin(1.5 * pi() * v)")]
_EDGES = """, n AS (
  SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) AS r, lead(v) OVER (PARTITION BY t ORDER BY v) AS nv, count(*) OVER (PARTITION BY t) AS c FROM z
), cuts AS (
  SELECT t, r // s AS k, (v + nv) / 2 AS e FROM (SELECT *, greatest(round_even(c / 4, 0), 1)::BIGINT AS s FROM n) WHERE r % s = 0 AND r // s < 4 AND nv IS NOT NULL
), grid AS (
  SELECT t, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT t FROM z), range(5) AS g(k)
), edges AS (
  SELECT grid.t, grid.k, CASE WHEN grid.k = 0 THEN 0.0::DOUBLE WHEN grid.k = 4 THEN 1.0::DOUBLE ELSE coalesce(e, 1.0::DOUBLE) END AS edge
  FROM grid LEFT JOIN cuts ON grid.t = cuts.t AND grid.k = cuts.k
)"""
_SPLIT = """, b AS (
  SELECT z.t, a.k AS bin, CASE WHEN h.edge > a.edge THEN (v - a.edge) / (h.edge - a.edge) END AS u
  FROM z JOIN edges a ON {0} a.k < 4 JOIN edges h ON {1} h.k = a.k + 1
), w AS (
  SELECT *, CASE WHEN u IS NULL THEN 0 WHEN abs(u - 0.5) = 0.5 THEN 0.5 WHEN abs(u - 0.5) < 0.5 THEN 1 ELSE 0 END AS rect FROM b
), parts AS (
  SELECT t, bin * 2 AS k, CASE WHEN rect = 0 THEN 0 ELSE rect * cos(pi() / 2 * u) END AS re FROM w
  UNION ALL SELECT t, bin * 2 + 1, CASE WHEN rect = 0 THEN 0 ELSE rect * sin(pi() / 2 * u) END FROM w
)
SELECT t, CAST(k AS INTEGER) AS k, count(*) AS n, round(sum(re)::DOUBLE, 4) AS total, CAST(count(*) FILTER (re <> 0) AS BIGINT) AS n_used FROM parts GROUP BY t, k"""


def balanced_edges(n_bins: int) -> str:
    """SQL of ``edges`` (t, k, edge) of ``z``: bins of equal weight, a class weighs 2**40 in all."""
    return f""", weights AS (SELECT label, 1099511627776 // count(*) AS w FROM (SELECT DISTINCT series_id, label FROM z) GROUP BY label
), heavy AS MATERIALIZED (
  SELECT t, v, w, (sum(w) OVER (PARTITION BY t ORDER BY v, series_id))::BIGINT AS upto, (sum(w) OVER (PARTITION BY t))::BIGINT AS c FROM z JOIN weights USING (label)
), steps AS (
  SELECT DISTINCT t, c, k, greatest(round_even(c / {n_bins}, 0), 1)::BIGINT * k AS r FROM heavy, range(1, {n_bins}) AS g(k)
), cuts AS (
  SELECT s.t, k, (any_value(v) FILTER (upto > r - 1 AND upto - w <= r - 1) + any_value(v) FILTER (upto > r AND upto - w <= r)) / 2 AS e
  FROM steps s JOIN heavy h ON s.t = h.t AND r < s.c GROUP BY s.t, k
), edges AS MATERIALIZED (
  SELECT t, CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k = {n_bins} THEN 1.0::DOUBLE ELSE coalesce(e, 1.0::DOUBLE) END AS edge
  FROM (SELECT DISTINCT t FROM z) CROSS JOIN range({n_bins} + 1) AS g(k) LEFT JOIN cuts USING (t, k)
)"""


_CLASS_EDGES = _EDGES.replace("PARTITION BY t", "PARTITION BY label, t").replace("SELECT t,", "SELECT label, t,").replace("DISTINCT t FROM", "DISTINCT label, t FROM").replace("grid.t,", "grid.label, grid.t,").replace("ON grid.t = cuts.t", "ON grid.label = cuts.label AND grid.t = cuts.t")
ORACLE_SQL = {
    "enc_stoudenmire": _sql(0.0, 1.0, _ANGLE),
    "enc_half_angle": _sql(0.0, 1.0, [("cos(pi() / 2 * v)", "0.0::DOUBLE"), ("sin(pi() / 2 * v)", "0.0::DOUBLE")]),
    "enc_qudit": _sql(-1.0, 1.0, [("cos(acos(v)) * (cos(atan(v)) + sin(atan(v))) / sqrt(2)", "0.0::DOUBLE"), ("cos(acos(v)) * (cos(atan(v)) - sin(atan(v))) / sqrt(2)", "0.0::DOUBLE"), ("sin(acos(v))", "0.0::DOUBLE")]),
    "enc_linear": _sql(0.0, 1.0, [("sqrt(1 - v)", "0.0::DOUBLE"), ("sqrt(v)", "0.0::DOUBLE")]),
    "enc_fourier": _sql(-1.0, 1.0, _fourier_sql("v", 5)),
    "enc_sahand": _sql(0.0, 1.0, _sahand_sql(4)),
    "enc_legendre": _sql(-1.0, 1.0, [(f"{p} / CAST({math.sqrt(math.sqrt(9 / 2) * 4)!r} AS DOUBLE)", "0.0::DOUBLE") for p in _LEGENDRE]),
    "enc_legendre_nonorm": _sql(-1.0, 1.0, [(p, "0.0::DOUBLE") for p in _LEGENDRE]),
    "enc_uniform": _sql(0.0, 1.0, [("1.0::DOUBLE / 3", "0.0::DOUBLE")] * 3),
    "split_uniform_edges": "SELECT CAST(k AS INTEGER) AS k, round(-1.0::DOUBLE + 2.0::DOUBLE * k / 4, 6) + 0.0 AS edge FROM range(5) AS r(k)",
    "split_hist_edges": f"WITH {ranged(0.0, 1.0)}{_EDGES} SELECT t, k, round(edge, 6) + 0.0 AS edge FROM edges",
    "split_hist_balanced": f"WITH {ranged(0.0, 1.0)}{balanced_edges(4)} SELECT t, k, round(edge, 6) + 0.0 AS edge FROM edges",
    "split_hist_by_class": f"WITH {ranged(0.0, 1.0)}{_CLASS_EDGES} SELECT label, t, k, round(edge, 6) + 0.0 AS edge FROM edges",
    "enc_uniform_split": f"WITH {ranged(0.0, 1.0)}, edges AS (SELECT k, k / 4.0::DOUBLE AS edge FROM range(5) AS r(k))" + _SPLIT.format("", ""),
    "enc_hist_split": f"WITH {ranged(0.0, 1.0)}{_EDGES}" + _SPLIT.format("a.t = z.t AND", "h.t = z.t AND"),
    "basis_grid": " UNION ALL ".join(
        f"SELECT CAST(i AS INTEGER) AS t, {k} AS k, round({re}, 6) + 0.0 AS re, round({im}, 6) + 0.0 AS im FROM range(41) AS r(i)"
        for k, (re, im) in enumerate(_fourier_sql("(-1.0::DOUBLE + i * 0.05::DOUBLE)", 5))
    ),
    "enc_fourier_by_time": f"""WITH {ranged(-1.0, 1.0)}, f AS (SELECT *, unnest([0, 1 + t % 3, -(1 + t % 3)]) AS n, CAST(unnest([0, 1, 2]) AS INTEGER) AS k FROM z)
SELECT series_id, t, k, round(cos(pi() * n * v) / sqrt(3.0::DOUBLE), 6) + 0.0 AS re, round(sin(pi() * n * v) / sqrt(3.0::DOUBLE), 6) + 0.0 AS im FROM f""",
    "enc_legendre_by_time": f"""WITH {ranged(-1.0, 1.0)}, f AS (SELECT *, unnest([t % 2, 2 + t % 2]) AS n, CAST(unnest([0, 1]) AS INTEGER) AS k FROM z),
p AS (SELECT *, CASE n WHEN 0 THEN 1 WHEN 1 THEN v WHEN 2 THEN (3 * v * v - 1) / 2 ELSE (5 * v * v * v - 3 * v) / 2 END AS p FROM f)
SELECT series_id, t, k, round(p * sqrt((2 * n + 1) / 2.0::DOUBLE) / sqrt(sqrt((2 * (2 + t % 2) + 1) / 2.0::DOUBLE) * 2), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM p""",
    "enc_letter_states": f"""WITH {CELLS}, p AS (SELECT t, min(v) AS lo, max(v) AS hi FROM cells GROUP BY t),
n AS (SELECT series_id, t, least(floor((v - lo) / ((hi - lo) / 4)), 3)::INT AS n FROM cells JOIN p USING (t))
SELECT series_id, t, CAST(k AS INTEGER) AS k, CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS re, 0.0::DOUBLE AS im FROM n, range(4) AS r(k)""",
    "enc_bit_states": f"""WITH {CELLS}, m AS (SELECT series_id, median(v) AS m FROM cells GROUP BY series_id)
SELECT series_id, t, CAST(k AS INTEGER) AS k, CASE WHEN (k = 1) = (v >= m) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS re, 0.0::DOUBLE AS im FROM cells JOIN m USING (series_id), range(2) AS r(k)""",
}
