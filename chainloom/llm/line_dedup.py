"""Line dedup by site-relative frequency, with DataFrame functions alone.

A line's frequency at a host is the share of the host's pages that contain it.
Lines above ``MAX_RATIO`` are boilerplate of that host, provided they stand on at
least ``LEAST_PAGES`` pages, and are dropped from all its pages; the other lines
stay in their order.

Each page sends its distinct lines as 128-bit hashes; counts by (host, line) are
summed in the tasks before the shuffle, so neither a hot host nor a very common
line lands in one task. A host has at most (lines a page) / ``MAX_RATIO``
boilerplate lines, whatever its number of pages; those lists, one row a host, are
joined to the pages (broadcast below Spark's limit, else a join whose hot hosts
Spark splits).

Defined results: null texts stay null with 0 lines; lines are compared without the
white space around them; blank lines are never dropped; a null host is a host of
its own; a text that loses all its lines becomes empty; repeated rows count as
pages of their own; an empty table gives an empty table. ``deduplicated`` returns the
id, host, text and counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import written

MAX_RATIO = 0.05
LEAST_PAGES = 5


def bare_line(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def line_key(bare: Column) -> Column:
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def is_blank(line: Column) -> Column:
    return F.length(bare_line(line)) == 0


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): keys of the lines above the ratio, one row for each host that has any. ``pages``: host, text."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), bare_line), lambda x: F.length(x) > 0)
    # distinct as strings, which Spark hashes: structs it compares each with all others, which a text of very many lines doesn't bear
    keys = pages.filter(F.col("text").isNotNull()).select("host", F.explode(F.transform(F.array_distinct(lines), line_key)).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    common = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > max_ratio * F.col("total"))
    return common.groupBy("host").agg(F.collect_list("key").alias("lines"))  # at most (lines a page) / max_ratio keys


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(doc_id, host, text, n_lines, n_dropped) of every row."""
    pages = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    common = written(boilerplate(pages, max_ratio, least_pages), "boilerplate").withColumnRenamed("host", "h")
    rows = pages.join(common, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    every = F.split("text", "\n", -1)
    kept = F.filter(every, lambda x: is_blank(x) | ~F.array_contains(F.coalesce("lines", F.array().cast("array<struct<a:bigint,b:bigint>>")), line_key(bare_line(x))))
    made = rows.withColumn("kept", kept)
    n = F.coalesce(F.size(every), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    dropped = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(every) - F.size("kept")).cast("long")
    return made.select("doc_id", "host", F.array_join("kept", "\n").alias("text"), n.alias("n_lines"), dropped.alias("n_dropped"))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, text FROM documents
), lines AS (
  SELECT k, doc_id, host, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM d WHERE text IS NOT NULL
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM lines
), totals AS (
  SELECT host, count(*) AS total FROM d GROUP BY host
), common AS (
  SELECT c.host, bare FROM (
    SELECT host, bare, count(DISTINCT k) AS n FROM keyed WHERE bare <> '' GROUP BY host, bare
  ) c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE n >= 5 AND n > 0.05 * total
), marked AS (
  SELECT keyed.*, common.bare IS NOT NULL AS drop_it
  FROM keyed LEFT JOIN common ON keyed.host IS NOT DISTINCT FROM common.host AND keyed.bare = common.bare
), joined AS (
  SELECT k, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '') AS text,
         count(*)::BIGINT AS n_lines, count(*) FILTER (drop_it)::BIGINT AS n_dropped
  FROM marked GROUP BY k
)
SELECT doc_id, host, joined.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN joined USING (k)
"""
