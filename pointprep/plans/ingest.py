"""Whole flows: CSV preparation, profile analysis, generation, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointprep.operators import dedup, match, profile, split, vocab

PIPELINE_CONFIDENCE, EXTRACT_CONFIDENCE = 0.6, 0.0


def prepare(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(rows text, label, label_id, split; vocabulary) from (text, target): strip, drop empty, number labels, split."""
    rows = profile.complete(df).withColumnRenamed("target", "label")
    labels = vocab.vocabulary(rows, "label")
    return split.three_way(rows, "label", key, train, val, test, seed).join(labels, "label"), labels


def generate(points: DataFrame, labels: DataFrame, order: list[str], min_confidence: float = PIPELINE_CONFIDENCE, rules: list = vocab.RULES) -> DataFrame:
    """Training rows (text, label, label_id) from points: first of each name, matched with enough confidence."""
    first = dedup.first_wins(points, "clean_name", order)
    return match.cascade(first, labels, rules=rules, min_confidence=min_confidence).where("label is not null").select(F.col("clean_name").alias("text"), "label", "label_id")


def extract(points: DataFrame, labels: DataFrame | None, min_confidence: float = EXTRACT_CONFIDENCE) -> DataFrame:
    """Extract rows by the additive scorer; what is not matched, or too weakly, has target '' and confidence 0."""
    if labels is None:
        found = points.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    else:
        found = match.additive(points, labels)
    ok = F.col("label").isNotNull() & (F.col("confidence") >= min_confidence)
    return found.select(F.col("clean_name").alias("text"), F.when(ok, F.col("label")).otherwise("").alias("target"), F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"), "raw_name", F.col("profile_name").alias("profile"), "source_file", "value_type")


def extract_records(extracted: DataFrame, labels: DataFrame, min_confidence: float = EXTRACT_CONFIDENCE) -> DataFrame:
    """JSONL records of an extract: targets that are not empty, with their ids."""
    kept = extracted.where((F.col("target") != "") & (F.col("confidence") >= min_confidence))
    return kept.select("text", F.col("target").alias("label")).join(labels, "label").select("text", "label", "label_id")
