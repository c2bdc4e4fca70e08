"""From raw documents to encoded training text, in five stages.

Every stage works on all that the one before kept; all but the last return the columns of
``documents``. Between stages the rows are a written table, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from claimloom.plans.lineage import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z keep the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.75 keep the smallest doc_id."""
    return jaccard_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents by source weight: some not at all, some twice, as separate rows."""
    return mixing.mixed_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode it again, and return both as digests."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode_text),
]

#: A trained classifier and a seeded selection are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
