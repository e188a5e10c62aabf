"""Merging of newly matched rows into training and validation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import new_entries
from .split import prefix, seeded


def merge(train: DataFrame, validation: DataFrame, new: DataFrame, key: str, ratio: float = 0.1, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame | None:
    """Rows with ``split`` after the merge, or None if ``new`` has nothing unknown.

    Existing rows are never deduplicated among themselves; ``exclude`` adds keys that must not come in.
    """
    existing = train.select("text").union(validation.select("text"))
    if exclude is not None:
        existing = existing.union(exclude.select("text"))
    fresh = new_entries(existing, new, "text", [key])
    if fresh.isEmpty():
        return None
    dealt = prefix(fresh, key, ratio, seed)
    return train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation"))).unionByName(dealt)


def counters(train: DataFrame, validation: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: n_new (rows of ``new``), n_unique (those that come in) and n_duplicates (known before, or repeated in ``new``)."""
    fresh = new_entries(train.select("text").union(validation.select("text")), new, "text", [key])
    both = fresh.select(F.lit(0).alias("all_")).union(new.select(F.lit(1).alias("all_")))
    n, unique = F.count_if(F.col("all_") == 1), F.count_if(F.col("all_") == 0)
    return both.agg(n.alias("n_new"), unique.alias("n_unique"), (n - unique).alias("n_duplicates"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in seeded order."""
    return df.orderBy(seeded(seed, key), key)
