"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from chainloom.llm import centroids, decontaminate, fill_in_middle, html_text, line_dedup, mixing, ngram_join, packing, quality_model, quality_rules, token_counts, token_store, warc
from chainloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark, sf_dir):
    return ngram_join.op1_ngram_join(table(spark, sf_dir, "documents"))


def op2_mixture(spark, sf_dir):
    return mixing.op2_mixture(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return html_text.op3_html_text(table(spark, sf_dir, "pages"))


def op4_quality_model(spark, sf_dir):
    return quality_model.op4_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_store(spark, sf_dir):
    return token_store.op5_token_store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.op6_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.op7_line_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.op8_warc(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    return token_counts.op9_token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.op10_quality_rules(table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    return packing.op11_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_centroid_clusters(spark, sf_dir):
    return centroids.op12_centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark, sf_dir):
    return fill_in_middle.op13_fill_in_middle(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixture": op2_mixture,
    "op3_html_text": op3_html_text,
    "op4_quality_model": op4_quality_model,
    "op5_token_store": op5_token_store,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op12_centroid_clusters": centroids.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
