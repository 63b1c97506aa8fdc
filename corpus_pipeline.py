"""A corpus from documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelsmith.llm.common import materialise
from panelsmith.llm.langid import keep_identified, learn_with_floors
from panelsmith.llm.packing import pack_documents
from panelsmith.llm.quality import keep_quality, learn_quality
from panelsmith.llm.secret_scan import redact_secrets
from panelsmith.llm.simhash import keep_one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at least 0.3 stay; it learns from the labels of documents that are here."""
    machine = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, machine, 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernels explain by a learnt language stay."""
    return keep_identified(docs, learn_with_floors(docs))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return keep_one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay, and ``n_chars`` is that of the masked text."""
    return redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, best fit first."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no expression for the learnt stages, the kernels and the tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
