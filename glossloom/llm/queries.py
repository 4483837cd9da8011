"""The registered queries of the subpackage on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossloom.llm import alignment, cover_tree, extraction, fingerprints, language, language_model, mixing, near_duplicates, packing, quality, tokens, toxicity, trie
from glossloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


@query
def op2_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"))


@query
def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, d, "documents"))


@query
def op5_language_model(spark: SparkSession, d: str) -> DataFrame:
    return language_model.scores(table(spark, d, "documents"))


@query
def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


@query
def op8_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, d, "embeddings"))


@query
def op9_language(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


@query
def op10_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, d, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.prefix_trie(table(spark, d, "conversations"))


@query
def op12_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, d, "documents"))


@query
def op13_main_text(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_pages(table(spark, d, "pages"))


SQL["op2_source_mix"] = mixing.MIX_SQL
SQL["op10_near_duplicates"] = near_duplicates.NEAR_SQL
SQL["op8_near_vectors"] = cover_tree.VECTOR_SQL
SQL["op11_prefix_trie"] = trie.TRIE_SQL
