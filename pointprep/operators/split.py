"""Exact stratified splits, and seeded order, in distributed form.

Sizes are ceil(share * n) as a whole; each class gets the floor of its share and the largest
remainders one more (ties to the smaller label). Within a class rows follow md5(seed:key), so a split
depends on data and seed alone. Class counts are a small table; it is joined back by broadcast below a checked size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import sized


def seeded(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def quotas(counts: DataFrame, label: str, total: int, n: int) -> DataFrame:
    """(label, quota): ``total`` of ``n`` rows dealt over the classes of ``counts`` (label, c) by largest remainder."""
    share = counts.withColumn("x_", F.lit(total).cast("long") * F.col("c")).withColumns({"f_": F.expr(f"x_ div {max(n, 1)}"), "m_": F.expr(f"x_ % {max(n, 1)}")})
    rank = F.row_number().over(Window.orderBy(F.col("m_").desc(), F.col(label)))
    missing = F.lit(total) - F.sum("f_").over(Window.partitionBy(F.lit(1)))
    return share.withColumns({"r_": rank, "e_": missing}).select(label, (F.col("f_") + (F.col("r_") <= F.col("e_")).cast("int")).alias("quota"))


def border(df: DataFrame, label: str, key: str, share: float, seed: int) -> tuple[DataFrame, int]:
    """((``label``, border, tied, tied_in) for each class, number of classes) for ceil(share * n) rows stratified by ``label``.

    Held are the rows up to ``border``, a place (hash, key) in the seeded order; of ``tied`` rows that stand there ``tied_in``.
    Null where a class gives none. Slices of the order are counted first, and only the slice with a class's border is ranked.
    """
    place = F.struct(seeded(seed, key).alias("h"), F.col(key).alias("k"))
    keyed = df.select(label, F.substring(seeded(seed, key), 1, 2).alias("slice_"), place.alias("o_"))
    slices = keyed.groupBy(label, "slice_").agg(F.count("*").alias("n_"))
    counts = slices.groupBy(label).agg(F.sum("n_").alias("c"))
    n, classes, least, nulls = counts.agg(F.sum("c"), F.count("*"), F.min("c"), F.sum(F.col(label).isNull().cast("int"))).first()
    n = n or 0
    total = math.ceil(share * n)
    if nulls:
        raise ValueError("labels must not be null; drop them first")
    if not n or least < 2 or total < classes or n - total < classes:
        raise ValueError("each class needs two rows, and each side as many rows as classes")
    dealt = quotas(counts, label, total, n)
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(label).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = slices.withColumn("before_", before).join(sized(dealt, classes), label).withColumn("room_", F.col("quota") - F.col("before_")).where("room_ > 0 and room_ <= n_").select(label, F.col("slice_").alias("edge_"), "room_")
    ranked = keyed.join(sized(room, classes), label).where("slice_ = edge_").groupBy(label, "room_", "o_").agg(F.count("*").alias("tied"))
    upto = ranked.withColumn("upto_", F.sum("tied").over(Window.partitionBy(label).orderBy("o_"))).where("upto_ >= room_ and upto_ - tied < room_")
    found = upto.select(label, F.col("o_").alias("border"), "tied", (F.col("room_") - F.col("upto_") + F.col("tied")).alias("tied_in"))
    # One row a class, looked up more than once: it is kept, and made again if it is lost.
    return counts.select(label).join(found, label, "left").persist(), classes


def marked(df: DataFrame, borders: tuple[DataFrame, int], label: str, key: str, seed: int, name: str, among: Column | None = None) -> DataFrame:
    """``df`` with boolean ``name`` for the rows (``among`` some) up to their class's border, decided where they are read."""
    table, classes = borders
    place = F.struct(seeded(seed, key).alias("h"), F.col(key).alias("k"))
    rows = df.withColumn("o_", place).join(sized(table, classes), label, "left")
    among = F.lit(True) if among is None else among
    held = among & F.coalesce(F.col("o_") <= F.col("border"), F.lit(False))
    if table.where("tied_in < tied").isEmpty():
        return rows.withColumn(name, held).select(*df.columns, name)
    # Rows that share their key with a border of which a part is held: these few are told apart by rank.
    split = among & F.coalesce((F.col("o_") == F.col("border")) & (F.col("tied_in") < F.col("tied")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(label).orderBy("o_"))
    return rows.where(~split).withColumn(name, held).unionByName(rows.where(split).withColumn(name, nth <= F.col("tied_in"))).select(*df.columns, name)


def hold_out(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with boolean ``held`` for ceil(share * n) rows, stratified by ``label``.

    Raises ValueError on null labels, classes of one row, or sides smaller than the number of classes.
    """
    return marked(df, border(df, label, key, share, seed), label, key, seed, "held")


def two_way(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: train or test."""
    return hold_out(df, label, key, test_size, seed).withColumn("split", F.when(F.col("held"), "test").otherwise("train")).drop("held")


def three_way(df: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the test part is held out first, then validation as val/(train+val) of the rest. Both borders are looked up in one pass."""
    first = hold_out(df, label, key, test, seed)
    second = border(first.where(~F.col("held")), label, key, val / (train + val), seed)
    both = marked(first, second, label, key, seed, "held_2_", ~F.col("held"))
    return both.withColumn("split", F.when(F.col("held"), "test").when(F.col("held_2_"), "validation").otherwise("train")).drop("held", "held_2_")


def prefix(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first floor(n * ratio) rows in seeded order are validation.

    Rows are counted by the first digits of their hash; only those of the border's digits are sorted.
    """
    h = seeded(seed, key)
    counts = sorted(df.groupBy(F.substring(h, 1, 4).alias("d")).count().collect())
    left = math.floor(sum(c for _, c in counts) * ratio)
    if not left:
        return df.withColumn("split", F.lit("train"))
    for digits, c in counts:
        if left <= c:
            break
        left -= c
    edge = df.where(F.substring(h, 1, 4) == digits).select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").offset(left - 1).limit(1).first()
    inside = (h < edge["h"]) | ((h == edge["h"]) & (F.col(key) <= edge["k"]))
    return df.withColumn("split", F.when(inside, "validation").otherwise("train"))
