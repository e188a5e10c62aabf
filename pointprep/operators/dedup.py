"""First-wins deduplication and anti-deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointprep.functions.text import dedup_key


def first_wins(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The first row by ``order`` of each lower-cased, stripped ``column``. Aggregates, so a hot key is combined before the shuffle."""
    columns = df.columns
    best = df.withColumn("k_", dedup_key(F.col(column))).groupBy("k_").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r_"))
    return best.select("r_.*")


def new_entries(existing: DataFrame, new: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows of ``new``, first wins, whose key is not in ``existing``."""
    known = existing.select(dedup_key(F.col(column)).alias("k_")).distinct()
    firsts = first_wins(new, column, order).withColumn("k_", dedup_key(F.col(column)))
    return firsts.join(known, "k_", "left_anti").drop("k_")


def row_number_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
