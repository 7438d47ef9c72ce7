"""Connected components of an edge table, by alternating large and small stars.

Every step is joins and aggregations over edges of two longs; nothing is gathered by
component. Each round is written to the shared folder in place of the one before, so a
lost executor costs one round at most. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import forget, written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both_ways(edges).filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: (u, v) longs in either direction. (node, component) of every node in
    them; a component is named by its least node."""
    loops = edges.filter("u = v")
    now = written(edges.filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        least = written(_least_neighbour(_both_ways(now)), "least")  # a join of two plain shuffles: Spark splits the edges of a hub
        last, now = now, written(_small_star(_large_star(now, least)).filter("u <> v").distinct(), "edges")
        forget(last, least)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return named.unionByName(roots).unionByName(alone.join(named.select("node").unionByName(roots.select("node")), "node", "left_anti"))
