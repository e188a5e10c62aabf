"""Cleaning, counting and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointprep.functions.text import percent, remove_spaces, strip


def clean_strings(df: DataFrame) -> DataFrame:
    """Blanks out of every string column."""
    return df.select(*[remove_spaces(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def is_complete(columns: tuple[str, ...]) -> Column:
    """Whether the stripped ``columns`` are neither null nor empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(strip(F.col(c))) > 0, F.lit(False))
    return out


def complete(df: DataFrame, columns: tuple[str, ...] = ("text", "target")) -> DataFrame:
    """Rows whose stripped ``columns`` are neither null nor empty; the columns come out stripped."""
    return df.where(is_complete(columns)).withColumns({c: strip(F.col(c)) for c in columns})


def removal_summary(df: DataFrame, columns: tuple[str, ...] = ("text", "target")) -> DataFrame:
    """One row: n_rows, n_kept and n_removed by ``complete``."""
    kept = F.count_if(is_complete(columns))
    return df.agg(F.count("*").alias("n_rows"), kept.alias("n_kept"), (F.count("*") - kept).alias("n_removed"))


def label_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label, n) by label; nulls do not count."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def class_counts(df: DataFrame, target: str, order: str) -> DataFrame:
    """(label, n, first_pos): most common first, ties by first appearance."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first_pos")).orderBy(F.desc("n"), "first_pos")


def top_labels(df: DataFrame, target: str, order: str, k: int = 15) -> DataFrame:
    return class_counts(df, target, order).limit(k)


def length_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: min, max, mean, median of the lengths in code points."""
    n = F.length(text)
    return df.agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"))


def dataset_summary(split: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row from rows with ``split``: counts, class distribution, text lengths. Class counts are one small table."""
    s = split.agg(
        F.count("*").alias("total_samples"), F.count_distinct(label).cast("int").alias("num_classes"),
        *[F.count_if(F.col("split") == x).alias(f"{x}_samples") for x in ("train", "validation", "test")],
        F.struct(F.min(F.length(text)).alias("min"), F.max(F.length(text)).alias("max"), F.avg(F.length(text)).alias("mean"), F.median(F.length(text)).alias("median")).alias("text_length_stats"),
    )
    counts = split.groupBy(label).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))).alias("c"))
    return s.crossJoin(counts).select("total_samples", "num_classes", "train_samples", "validation_samples", "test_samples", F.map_from_arrays(F.col("c.l"), F.transform("c.m", lambda m: -m)).alias("class_distribution"), "text_length_stats")


def match_summary(matched: DataFrame, name: str = "clean_name") -> DataFrame:
    """One row: points, matched, unmatched, their percentages, distinct unmatched names."""
    hit = F.col("label").isNotNull()
    n, m = F.count("*"), F.count_if(hit)
    return matched.agg(n.alias("total"), m.alias("matched"), (n - m).alias("unmatched"), percent(m, n).alias("matched_pct"), percent(n - m, n).alias("unmatched_pct"), F.count_distinct(F.when(~hit, F.col(name))).alias("distinct_unmatched"))


def unmatched_report(matched: DataFrame, name: str = "clean_name", profile: str = "profile_name", order: str = "pos") -> DataFrame:
    """(point_name, occurrence_count, num_profiles, suggested_label): most frequent first, ties by first appearance. A null profile counts as one."""
    rows = matched.where("label is null").groupBy(F.col(name).alias("point_name")).agg(
        F.count("*").alias("occurrence_count"), (F.count_distinct(profile) + F.max(F.col(profile).isNull().cast("int"))).alias("num_profiles"), F.min(order).alias("first_pos")
    )
    return rows.orderBy(F.desc("occurrence_count"), "first_pos").select("point_name", "occurrence_count", "num_profiles", F.lit(None).cast("string").alias("suggested_label"))
