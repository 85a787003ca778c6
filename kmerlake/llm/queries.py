"""The ``opN_<name>`` queries: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerlake.llm import oracles
from kmerlake.llm.tables import table

#: Where the public vocabularies lie; every executor has them there.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    return f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), extend=True).select("doc_id", "text", "cut_lines", "cut_by_chunk", "cut_by_long_line", "cut_by_extension")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.qda import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.hdlang import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.fertility import text_quality

    return text_quality(table(spark, sf_dir, "documents"), piece_model())


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.pii import personal_data_report

    return personal_data_report(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.spm import encode

    found = encode(table(spark, sf_dir, "documents"), piece_model())
    return found.select("doc_id", "n_tokens", F.xxhash64("token_ids").alias("ids_hash"), "parity", "round_trip")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.decontam import scan_benchmark

    found = scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.prefixtrie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.topk import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.llm.spelling import spelling_forms

    return spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_personal_data": op7_personal_data,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.JACCARD,
    "op3_secret_scan": oracles.SECRETS,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_conversation_trie": oracles.TRIE,
    "op12_exact_top_k": oracles.NEAREST,
    "op13_spelling_variants": oracles.SPELLING,
}
