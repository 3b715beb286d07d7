"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    lexical_search,
    line_dedup,
    lm_scoring,
    near_dedup,
    pii,
    quality_rules,
    secret_scan,
    spot_signatures,
    token_counts,
    url_filters,
)
from emberwatch.llm.common import read_table

QueryFunction = Callable[[SparkSession, str], DataFrame]

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read_table(spark, sf_dir, "pages"), url_filters.RULES)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(read_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read_table(spark, sf_dir, "documents"), UNIGRAM_PIECES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.summary(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.summary(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(read_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.summary(read_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.summary(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.summary(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, QueryFunction] = {
    "op1_url_filters": op1_url_filters,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spot_signatures": op11_spot_signatures,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op11_spot_signatures": spot_signatures.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
