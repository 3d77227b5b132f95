"""Registered queries of the operators, over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtledger.llm.aho_decontaminate import contamination_digests
from courtledger.llm.block_neighbours import nearest
from courtledger.llm.chunked_fim import digests, fill_in_middle
from courtledger.llm.cotrain_quality import quality_scores
from courtledger.llm.dom_content import page_texts
from courtledger.llm.lpf_dedup import repeat_digests
from courtledger.llm.lsh_forest import near_duplicates
from courtledger.llm.potential_audit import filter_audit
from courtledger.llm.ppm_language import held_out_languages
from courtledger.llm.rans_tokens import token_file
from courtledger.llm.resync_counts import token_counts
from courtledger.llm.rule_ledger import ledger, verdicts
from courtledger.llm.tree_bpe import encode_and_decode
from courtledger.llm.workers import importable


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/documents.parquet")


def op1_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return token_file(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op2_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    return held_out_languages(documents(spark, folder))


def op3_aho_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_digests(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op4_cotrain_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op6_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), keep_words=True)


def op7_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), size=4)


def op8_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(ledger(documents(spark, folder))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op9_dom_content(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(importable(spark).read.parquet(f"{folder}/pages.parquet"))


def op10_lpf_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(documents(spark, folder))


def op11_potential_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op12_block_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(importable(spark).read.parquet(f"{folder}/embeddings.parquet"))


def op13_chunked_fim(spark: SparkSession, folder: str) -> DataFrame:
    return digests(fill_in_middle(documents(spark, folder)))


QUERIES = {
    "op1_token_file": op1_token_file,
    "op2_ppm_language": op2_ppm_language,
    "op3_aho_decontaminate": op3_aho_decontaminate,
    "op4_cotrain_quality": op4_cotrain_quality,
    "op5_token_counts": op5_token_counts,
    "op6_tree_bpe": op6_tree_bpe,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_dom_content": op9_dom_content,
    "op10_lpf_dedup": op10_lpf_dedup,
    "op11_potential_audit": op11_potential_audit,
    "op12_block_neighbours": op12_block_neighbours,
    "op13_chunked_fim": op13_chunked_fim,
}

