"""Corpus pipeline of the llm subpackage: quality, near-duplicates, personal data, mixture, tokens.

Every stage is (spark, docs, sf_dir) -> DataFrame; it works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointprep.llm import mixing, pii, quality, simhash, wfst
from pointprep.llm.common import cut, delete, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return simhash.unique(docs, shingle=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""
    return wfst.report(docs)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("PII", private),
    ("mixing", mixture),
    ("SentencePiece", tokens),
]

#: SQL cannot express a fitted classifier, fingerprint components or tokenisation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for at, (_, stage) in enumerate(STAGES):
        with written() as made:
            docs = stage(spark, docs, sf_dir)
            if at + 1 < len(STAGES):
                docs = cut(docs)
                # What the stage wrote on its way, and what it read, is not needed again.
                delete(spark, [*before, *made[:-1]])
                before = made[-1:]
    return docs
