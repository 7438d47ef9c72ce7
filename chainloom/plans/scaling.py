"""Queries on scaling, discretisation and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions import scaling as P
from chainloom.functions.quantiles import exact_quantiles, grouped_quantiles
from chainloom.operators import series as S
from chainloom.plans.common import CELLS, SIGMOID, embeddings, ranged, six, table


def _long(series, name="v"):
    return S.long_form(series).select("series_id", "label", "t", six(F.col("v")).alias(name))


def scale_quantiles(spark, d):
    q = exact_quantiles(embeddings(spark, d).select(F.explode("x").alias("v")), F.col("v"), [0.25, 0.5, 0.75])
    return spark.createDataFrame([tuple(q)], "q1 double, q2 double, q3 double").select(*[six(F.col(c)).alias(c) for c in ("q1", "q2", "q3")])


def scale_robust_sigmoid(spark, d):
    s = embeddings(spark, d)
    return _long(P.RobustSigmoid.fit(s).transform(s))


def scale_signed_sigmoid(spark, d):
    s = embeddings(spark, d)
    return _long(P.RobustSigmoid.fit(s).transform(s, signed=True))


def scale_sigmoid(spark, d):
    return _long(embeddings(spark, d).withColumn("x", F.transform("x", lambda v: P.sigmoid(v))))


def scale_minmax_range(spark, d):
    return _long(P.scaled(embeddings(spark, d), to=(-1.0, 1.0))[0])


def scale_standard(spark, d):
    s = embeddings(spark, d)
    return P.standard_transform(s, P.standard_fit(s)).select("series_id", "label", "t", six(F.col("v")).alias("v"))


def _binarised(method):
    def query(spark, d):
        return embeddings(spark, d).select("series_id", F.posexplode(P.binarised(F.col("x"), method)).alias("t", "b"))

    return query


def sax_normal(spark, d):
    s = embeddings(spark, d)
    z = P.standard_transform(s, P.standard_fit(s, sample=True))
    return z.select("series_id", "t", P.letter(P.cut_bin(F.col("v"), P.sax_cuts(5))).alias("symbol"))


def sax_quantile(spark, d):
    long = S.long_form(embeddings(spark, d))
    cuts = grouped_quantiles(long, ["t"], "v", [0.25, 0.5, 0.75]).select("t", F.col("quantiles").alias("cuts"))
    return long.join(cuts, "t").select("series_id", "t", P.letter(P.cut_bin(F.col("v"), F.col("cuts"))).alias("symbol"))


def sax_uniform(spark, d):
    long = S.long_form(embeddings(spark, d))
    extent = long.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return long.join(extent, "t").select("series_id", "t", P.letter(P.uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), 4)).alias("symbol"))


def one_hot_labels(spark, d):
    return embeddings(spark, d).select("series_id", F.posexplode(P.one_hot(F.col("label"), 10)).alias("c", "y"))


def window_daily_series(spark, d):
    w = S.daily_windows(table(spark, d, "events"), "ts", "value")
    return w.select("day", "label", F.posexplode("x").alias("hour", "v")).select(F.col("day").cast("string").alias("day"), "label", "hour", six(F.col("v")).alias("v"))


def window_daily_by_type(spark, d):
    """Windows by day of each type of event, as of each household of a meter table."""
    w = S.daily_windows(table(spark, d, "events"), "ts", "value", ["event_type"])
    return w.select("event_type", "day", "label", F.posexplode("x").alias("hour", "v")).select("event_type", F.col("day").cast("string").alias("day"), "label", "hour", six(F.col("v")).alias("v"))


def class_counts(spark, d):
    return S.class_counts(embeddings(spark, d))


def class_index(spark, d):
    return S.label_index(embeddings(spark, d))


def class_balance(spark, d):
    return S.is_balanced(embeddings(spark, d))


def structural_checks(spark, d):
    return S.problems(embeddings(spark, d))


def stratified_kfold(spark, d):
    return S.stratified_folds(embeddings(spark, d), 5, F.col("series_id"))


def plain_kfold(spark, d):
    return S.folds(embeddings(spark, d), 7)


def class_balanced_sample(spark, d):
    return S.balanced(embeddings(spark, d), F.col("series_id")).select("series_id", "label")


def stacked_subsets(spark, d):
    """Three groups of labels, as many series of each as the smallest has."""
    groups = {label: int(label > 2) + int(label > 4) for label in range(10)}
    return S.stacked(embeddings(spark, d), groups, F.col("series_id")).select("series_id", F.col("label").cast("int").alias("label"))


def sample_per_class(spark, d):
    return S.sampled_per_class(embeddings(spark, d), 20, F.col("series_id")).select("series_id", "label")


def validation_split(spark, d):
    return S.stratified_split(embeddings(spark, d), 0.1, F.col("series_id")).select("series_id", "label", "split")


def horizon_split(spark, d):
    s = embeddings(spark, d)
    a, b = S.head_of(s, 16), S.tail_of(s, 16)
    part = lambda x, name: x.select("series_id", F.lit(name).alias("part"), F.size("x").cast("long").alias("n"), six(F.element_at("x", 1)).alias("first"), six(F.element_at("x", -1)).alias("last"))
    return part(a, "known").unionByName(part(b, "horizon"))


def relabel_two_classes(spark, d):
    """Even labels become -1, odd ones 1."""
    s = S.relabelled(embeddings(spark, d), {c: 1 if c % 2 else -1 for c in range(10)})
    return s.select("series_id", F.col("label").cast("int").alias("label"))


def transpose_time(spark, d):
    long = S.long_form(embeddings(spark, d))
    return long.groupBy("t").agg(F.count("*").alias("n"), six(F.sum("v")).alias("total"), six(F.min("v")).alias("least"), six(F.max("v")).alias("greatest"))


def index_complement(spark, d):
    s = embeddings(spark, d)
    return S.complement(s, S.sampled_per_class(s, 20, F.col("series_id"))).select("series_id", "label")


NAMES = [
    "scale_quantiles", "scale_robust_sigmoid", "scale_signed_sigmoid", "scale_sigmoid", "scale_minmax_range", "scale_standard", "sax_normal", "sax_quantile",
    "sax_uniform", "one_hot_labels", "window_daily_series", "window_daily_by_type", "class_counts", "class_index", "class_balance", "structural_checks", "stratified_kfold", "plain_kfold",
    "class_balanced_sample", "stacked_subsets", "sample_per_class", "validation_split", "horizon_split", "relabel_two_classes", "transpose_time", "index_complement",
]
QUERIES = {n: globals()[n] for n in NAMES} | {f"binarise_{m}": _binarised(m) for m in ("median", "mean", "minimum")}

_RANK = "SELECT vec_id AS series_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings"
_LONG = "SELECT series_id, label, t, round({}, 6) + 0.0 AS v FROM {}"
_CUTS = " + ".join(f"CASE WHEN v > CAST({c!r} AS DOUBLE) THEN 1 ELSE 0 END" for c in P.sax_cuts(5))
_POINT = CELLS + ", p AS (SELECT t, avg(v) AS a, stddev_pop(v) AS sp, stddev_samp(v) AS ss, min(v) AS lo, max(v) AS hi, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM cells GROUP BY t)"
ORACLE_SQL = {
    "scale_quantiles": f"WITH {CELLS} SELECT round(quantile_cont(v, 0.25), 6) + 0.0 AS q1, round(quantile_cont(v, 0.5), 6) + 0.0 AS q2, round(quantile_cont(v, 0.75), 6) + 0.0 AS q3 FROM cells",
    "scale_robust_sigmoid": f"WITH {SIGMOID} " + _LONG.format("p", "sig"),
    "scale_signed_sigmoid": f"WITH {SIGMOID} " + _LONG.format("2 * p - 1", "sig"),
    "scale_sigmoid": f"WITH {CELLS} " + _LONG.format("1 / (1 + exp(-v))", "cells"),
    "scale_minmax_range": f"WITH {ranged(-1.0, 1.0)} " + _LONG.format("v", "z"),
    "scale_standard": f"WITH {_POINT} SELECT series_id, label, t, round((v - a) / sp, 6) + 0.0 AS v FROM cells JOIN p USING (t)",
    "sax_normal": f"WITH {_POINT}, z AS (SELECT series_id, t, (v - a) / ss AS v FROM cells JOIN p USING (t)) SELECT series_id, t, chr(97 + {_CUTS}) AS symbol FROM z",
    "sax_quantile": f"WITH {_POINT} SELECT series_id, t, chr(97 + len(list_filter(q, lambda c: v > c))::INT) AS symbol FROM cells JOIN p USING (t)",
    "sax_uniform": f"WITH {_POINT} SELECT series_id, t, chr(97 + least(floor((v - lo) / ((hi - lo) / 4)), 3)::INT) AS symbol FROM cells JOIN p USING (t)",
    "one_hot_labels": "SELECT vec_id AS series_id, CAST(c AS INTEGER) AS c, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM embeddings, range(10) AS r(c)",
    "window_daily_series": """
WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, avg(value) AS v FROM events GROUP BY ALL),
g AS (SELECT day, CAST(hour AS INTEGER) AS hour FROM (SELECT DISTINCT day FROM h), range(24) AS r(hour)),
f AS (
  SELECT g.day, g.hour, last_value(v IGNORE NULLS) OVER (PARTITION BY g.day ORDER BY g.hour) AS b,
         first_value(v IGNORE NULLS) OVER (PARTITION BY g.day ORDER BY g.hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM g LEFT JOIN h ON g.day = h.day AND g.hour = h.hour
)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN isodow(day) IN (6, 7) THEN 1 ELSE 0 END AS label, hour, round(coalesce(b, a), 6) + 0.0 AS v FROM f""",
    "window_daily_by_type": """
WITH h AS (SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS hour, avg(value) AS v FROM events GROUP BY ALL),
g AS (SELECT event_type, day, CAST(hour AS INTEGER) AS hour FROM (SELECT DISTINCT event_type, day FROM h), range(24) AS r(hour)),
f AS (
  SELECT g.event_type, g.day, g.hour, last_value(v IGNORE NULLS) OVER (PARTITION BY g.event_type, g.day ORDER BY g.hour) AS b,
         first_value(v IGNORE NULLS) OVER (PARTITION BY g.event_type, g.day ORDER BY g.hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.day = h.day AND g.hour = h.hour
)
SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN isodow(day) IN (6, 7) THEN 1 ELSE 0 END AS label, hour, round(coalesce(b, a), 6) + 0.0 AS v FROM f""",
    "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "class_index": "SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS label_index FROM (SELECT DISTINCT label FROM embeddings)",
    "class_balance": "SELECT min(n) = max(n) AS balanced, count(*) AS n_classes FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
    "structural_checks": """SELECT CAST(min(len(embedding)) AS INTEGER) AS least_length, CAST(max(len(embedding)) AS INTEGER) AS greatest_length,
      count(DISTINCT label) AS n_classes, CAST(count(*) FILTER (label IS NULL) AS BIGINT) AS null_labels,
      CAST(count(*) FILTER (list_contains(list_transform(embedding, lambda v: v IS NULL), true)) AS BIGINT) AS series_with_nulls FROM embeddings""",
    "stratified_kfold": f"SELECT series_id, label, CAST(r % 5 + 1 AS INTEGER) AS fold FROM ({_RANK})",
    "plain_kfold": "SELECT vec_id AS series_id, CAST(ntile(7) OVER (ORDER BY vec_id) AS INTEGER) AS fold FROM embeddings",
    "class_balanced_sample": f"SELECT series_id, label FROM ({_RANK}) WHERE r < (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))",
    "sample_per_class": f"SELECT series_id, label FROM ({_RANK}) WHERE r < 20",
    "validation_split": f"SELECT series_id, label, CASE WHEN r < round(n * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ({_RANK}))",
    "horizon_split": """SELECT vec_id AS series_id, 'known' AS part, len(embedding) - 16 AS n, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(embedding[len(embedding) - 16]::DOUBLE, 6) + 0.0 AS last FROM embeddings
      UNION ALL SELECT vec_id, 'horizon', 16, round(embedding[len(embedding) - 15]::DOUBLE, 6) + 0.0, round(embedding[len(embedding)]::DOUBLE, 6) + 0.0 FROM embeddings""",
    "stacked_subsets": """WITH g AS (SELECT vec_id AS series_id, (CASE WHEN label > 4 THEN 2 WHEN label > 2 THEN 1 ELSE 0 END)::INTEGER AS label FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY series_id) AS r FROM g)
SELECT series_id, label FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM g GROUP BY label))""",
    "relabel_two_classes": "SELECT vec_id AS series_id, CAST(CASE label % 2 WHEN 0 THEN -1 ELSE 1 END AS INTEGER) AS label FROM embeddings",
    "transpose_time": f"WITH {CELLS} SELECT t, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(min(v), 6) + 0.0 AS least, round(max(v), 6) + 0.0 AS greatest FROM cells GROUP BY t",
    "index_complement": f"SELECT series_id, label FROM ({_RANK}) WHERE r >= 20",
    "binarise_median": f"WITH {CELLS}, m AS (SELECT series_id, median(v) AS m FROM cells GROUP BY series_id) SELECT series_id, t, CASE WHEN v >= m THEN 1 ELSE 0 END AS b FROM cells JOIN m USING (series_id)",
    "binarise_mean": f"WITH {CELLS}, m AS (SELECT series_id, avg(v) AS m FROM cells GROUP BY series_id) SELECT series_id, t, CASE WHEN v >= m THEN 1 ELSE 0 END AS b FROM cells JOIN m USING (series_id)",
    "binarise_minimum": f"WITH {CELLS}, m AS (SELECT series_id, min(v) AS m FROM cells GROUP BY series_id) SELECT series_id, t, CASE WHEN v = m THEN 0 ELSE 1 END AS b FROM cells JOIN m USING (series_id)",
}
