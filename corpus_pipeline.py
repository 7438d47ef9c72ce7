"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

Each stage takes all rows that the stage before kept, and is written as Parquet and
read again before the next one. All stages but the last return the columns of
``documents``.

Defined results: null and empty texts go with the first stage, as texts of fewer than 50
words do; repeated rows are copies, of which the second stage keeps one; near copies with ids
are named by the least one, so ties in similarity don't matter; rows with a null id are told
apart by their texts, and a null source is a source; very long texts are taken whole; further
columns, whatever their names, go along to the last stage, which ignores them; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm import decontaminate, mixing, ngram_join, quality_rules, token_store
from chainloom.llm.common import forget, table, written
from chainloom.llm.queries import tokenizer_path

#: SQL can't express the verified MinHash join in reasonable time, the hash-ordered mix or the token store.
ORACLE_SQL = None


def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, or their host's verdict, reject go."""
    return quality_rules.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similarity 0.8 or more stays: the one of least id."""
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document comes whole once for each time the mix takes it."""
    return mixing.mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mix in a token store, read back: (doc_id, start, n_tokens, ids_crc32, frame_bytes)."""
    return token_store.op5_token_store(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rule_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # a table of this run alone, never the input
    return docs
