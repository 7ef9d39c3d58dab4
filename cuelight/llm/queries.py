"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelight.llm import arrow_store, fim, html_extract, jaccard, language_model, licenses, mixing, neighbours, packing, pii, prefix_trie, quality, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, places = arrow_store.write_tokens(table(spark, sf_dir, "documents"))
    return arrow_store.read_digests(uri, places).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_html_main_text, op2_block_matrix_ann, op3_license_scan, op4_quality_rules, op5_source_mixing, op6_private_spans, op7_ngram_jaccard, op8_token_files, op9_packing, op10_sharding, op11_fill_in_middle, op12_backoff_automaton, op13_prefix_trie)}


def oracle_sql():
    return {"op2_block_matrix_ann": neighbours.oracle(), "op3_license_scan": licenses.oracle(), "op4_quality_rules": quality.oracle(), "op5_source_mixing": mixing.oracle(), "op7_ngram_jaccard": jaccard.oracle(),
            "op11_fill_in_middle": fim.oracle(), "op12_backoff_automaton": language_model.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
