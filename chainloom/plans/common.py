"""Tables of the queries, and SQL pieces that their oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import series as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled series of the tables: 64 values, labels 0 to 9."""
    return S.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def six(c: Column) -> Column:
    return F.round(c, 6) + 0.0


CELLS = """cells AS (
  SELECT vec_id AS series_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS t
  FROM embeddings
)"""

SIGMOID = (
    CELLS
    + """, q AS (
  SELECT quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM cells
), sig AS (
  SELECT series_id, label, t, 1 / (1 + exp(-(v - m) / (iqr / CAST(1.35 AS DOUBLE)))) AS p FROM cells, q
)"""
)


def ranged(low: float, high: float) -> str:
    """SQL of ``z``: the scaled values in [low, high]."""
    return SIGMOID + f""", mm AS (
  SELECT min(p) AS lo, max(p) AS hi FROM sig
), z AS (
  SELECT series_id, label, t, CAST({low} AS DOUBLE) + CAST({high - low} AS DOUBLE) * ((p - lo) / (hi - lo)) AS v FROM sig, mm
)"""
