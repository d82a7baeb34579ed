"""The corpus pipeline: five stages over ``documents``, each written and read again by whoever runs them.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last one encodes
what is left. Other columns than ``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars`` pass through unchanged, whatever their
names. Every stage takes rows with nulls in any column, empty and repeated texts, repeated ids and empty tables; it decides
each row by its own values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lotwise.llm.bpe_codec import encode_documents
from lotwise.llm.common import persist_table, table
from lotwise.llm.decontaminate import drop_leaked
from lotwise.llm.near_dedup import drop_near_duplicates
from lotwise.llm.quality import fit_quality, keep_good
from lotwise.llm.secrets import redact_secrets

#: Every stage learns, matches or searches in ways that SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; empty texts are judged like any other."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: the one with the least id. Rows are decided by their texts, so rows
    of one id, or without an id, are decided each."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; empty ones stay."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; ``n_chars`` of a changed text is counted anew."""
    return redact_secrets(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (none for null and empty ones); its decoded bytes are hashed for the round trip."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("byte_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = persist_table(docs)
    return docs
