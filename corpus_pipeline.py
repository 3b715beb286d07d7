"""From raw documents to token ids: the corpus operators one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import byte_bpe, decontamination, line_dedup, near_dedup, quality_rules
from emberwatch.llm.common import read_table, tune_for_texts, written

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much with them."""
    tune_for_texts(spark)
    return _counted(quality_rules.cleaned(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have go from all of them."""
    tune_for_texts(spark)
    return _counted(line_dedup.drop_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    tune_for_texts(spark)
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, with digests of them and of the bytes they decode to."""
    tune_for_texts(spark)
    return byte_bpe.summary(docs, BPE_RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: SQL has no byte-pair merges; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
