"""Quality rules: document rules, host failure rates under an empirical beta prior.

Each document is measured over its whole text and fails the base rules or not.
Failures are summed by host (a partial aggregate, so a hot host costs one row for
each task), a beta prior is fitted to the hosts' rates by moments, each rate is
shrunk towards the prior's mean, and hosts whose shrunken rate exceeds the limit are
rejected with all their documents. The limit comes from the fitted prior: its mean
and ``DEVIATIONS`` standard deviations, twice the mean at least, and always within
``LIMITS`` (so that no host falls for a rate that is small, and none stays of whose
documents half fail). It is compared at ``DIGITS`` digits, as are the rates.

Defined results: a null text has no words; a null host is a host of its own;
empty tables give empty tables; with one host, or hosts of equal rates, the prior
takes its greatest strength; repeated rows are measured and counted each. Other
columns of the input are kept by ``passing`` and ignored by ``verdicts``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, text_or_empty, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
SPACES = re.compile("[\x20\x09-\x0d]").findall
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
DEVIATIONS, LIMITS, DIGITS = 2.0, (0.2, 0.5), 9
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def repeat_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes are split at \x20 and \x09-\x0D alone
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")] if "\n" in text else []
    return len(words), len(text) - len(SPACES(text)), len(SYMBOLS(text)), len(lines) - len(set(lines)), repeat_words(words)


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    schema = "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)

    def make(columns):
        found = list(zip(*map(measure, columns[2]))) or [[]] * len(MEASURES)
        return {"doc_id": columns[0], "host": columns[1]} | dict(zip(MEASURES, found))

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), text_or_empty(text_col)), make, schema)


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(base: DataFrame, deviations: float = DEVIATIONS, limits: tuple[float, float] = LIMITS) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_limit): rates shrunk towards the prior, and the limit that it
    sets. ``base`` has host and base_failed."""
    hosts = written(base.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row
    mean = mean or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread else MOST_STRENGTH
    strength = min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)
    deviation = (mean * (1 - mean) / (strength + 1)) ** 0.5
    limit = min(max(2 * mean, mean + deviations * deviation, limits[0]), limits[1])
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumns({"host_rate": F.round(shrunk, DIGITS), "host_limit": F.round(F.lit(limit), DIGITS)})


def _with_rates(base: DataFrame, rates: DataFrame) -> DataFrame:
    """One row of ``rates`` for each host; Spark broadcasts it below its size limit and else splits hot hosts."""
    return base.join(rates.select(F.col("host").alias("rated_host"), "host_rate", "host_limit"), F.col("host").eqNullSafe(F.col("rated_host")), "left").drop("rated_host")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limit) -> DataFrame:
    """(doc_id, host, measures, base_failed, host_rate, host_limit, kept) of every row; ``limit`` goes to ``host_rates``."""
    base = written(measured(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()), "measures")
    return _with_rates(base, host_rates(base, **limit)).withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= F.col("host_limit")))


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limit) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns. Texts are measured
    twice, once for the hosts and once for the rows, so that no text is shuffled."""

    def fails(columns):
        return {"host": columns[0], "base_failed": [w < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * w for w, _, _, _, r in map(measure, columns[1])]}

    base = map_rows(docs.select(F.col(host_col).cast("string"), text_or_empty(text_col)), fails, "host string, base_failed boolean")
    good = written(host_rates(base, **limit).filter("host_rate <= host_limit").select(F.col("host").alias("good_host")), "good-hosts")
    from_good = docs.join(good, docs[host_col].cast("string").eqNullSafe(good["good_host"]), "left_semi")
    return _rows_passing_base(from_good, text_col)


def _rows_passing_base(docs: DataFrame, text_col: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch, keep = whole.slice(start, 1000), []
                for text in batch.column(at).to_pylist():
                    w, _, _, _, r = measure(text or "")
                    keep.append(not (w < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * w))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", *MEASURES, "base_failed", "kept", "host_rate", "host_limit")


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), spots AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT k, i FROM spots QUALIFY count(*) OVER (PARTITION BY k, gram) > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, range(3) AS r(j) GROUP BY k
), base AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (k)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source
), prior AS (
  SELECT avg(f / n) AS m,
         least(greatest(coalesce(avg(f / n) * (1 - avg(f / n)) / nullif(var_pop(f / n), 0) - 1, 1000), 2), 1000) AS s
  FROM hosts
), rates AS (
  SELECT source, round((f + m * s) / (n + s), 9) AS host_rate,
         round(least(greatest(2 * m, m + 2 * sqrt(m * (1 - m) / (s + 1)), 0.2), 0.5), 9) AS host_limit
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= host_limit AS kept, host_rate, host_limit
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""
