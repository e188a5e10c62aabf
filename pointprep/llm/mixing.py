"""Mixing sources to target weights by subset-sum budget fitting.

Each source takes whole copies of all its documents as often as its target allows; what remains of
the target is a budget for one more copy of some of them. Documents of a source are counted by exact
length; every length first gets its proportional share of the budget, and bounded-knapsack dynamic
programming over the counts that are left fits the rest. Which documents of a length are taken
follows a seeded hash: of each length there is one border, up to which documents are taken, so
whole rows are decided where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, spread, text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 42
#: Rows of a length in which its border is sought by ranking, about.
SLICE = 256
#: Least width, in words, of the table of sums; it is twice the longest text where that is more.
REACH = 1 << 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from the sums (source, source_size).

    Weights go round the sources by code point, null last. Where a share is over ``most`` times the
    source's size it stops there and the excess goes to the others by weight, until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # One row a source: the sums, not the documents, pass through this window.
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("at", F.lit(len(weights))).cast("int") + 1))
    ranked = cut(ranked.select("source", "source_size", F.col("weight").cast("double").alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at_most = F.lit(level) * F.col("weight") >= most * F.col("source_size") if full >= 0 else F.lit(False)
        stop, free, n = ranked.agg(F.sum(F.when(at_most, most * F.col("source_size")).otherwise(0)), F.sum(F.when(at_most, 0).otherwise(F.col("weight"))), F.sum(at_most.cast("int"))).first()
        if n == full or not free:
            break
        level, full = (share * total - stop) / free, n
    return ranked.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def subset_sum(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each (length, count) to take so that the sum is as near below ``budget`` as can be.

    A table of the sums up to ``budget``, each with the step that first reached it; counts are split
    in powers of two. Stops when ``budget`` itself is reached. Memory is five bytes a word of the budget.
    """
    first = np.full(budget + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for length, count in items:
        if not 0 < length <= budget:
            continue
        left, k = min(count, budget // length), 1
        while left and first[budget] < 0:
            k_ = min(k, left)
            w = length * k_
            if w > budget:
                break
            fresh = (first[: budget + 1 - w] >= 0) & (first[w:] < 0)
            first[w:][fresh] = len(steps)
            steps.append((length, k_))
            left, k = left - k_, k * 2
        if first[budget] >= 0:
            break
    at, taken = int(np.nonzero(first >= 0)[0][-1]), {}
    while at:  # the sum before a step was reached by an earlier one
        length, k = steps[first[at]]
        taken[length] = taken.get(length, 0) + k
        at -= length * k
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Of each length how many to take, for a sum as near to ``budget`` as can be, from below.

    After the proportional shares the longest texts are taken until the rest is within the table of
    sums; the table is wider than any text, so the rest never falls short of it by that. What is missing
    in the end is less than the shortest text that is not taken.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    quota = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((quota * lengths).sum())
    table = max(REACH, 2 * int(lengths[counts > quota].max(initial=0)))
    for i in order:
        n = int(lengths[i])
        if n and rest > table:
            add = min(-(-(rest - table) // n), int(counts[i] - quota[i]))
            quota[i] += add
            rest -= add * n
    left = [(int(lengths[i]), int(counts[i] - quota[i])) for i in order if counts[i] > quota[i]]
    place = {int(n): i for i, n in enumerate(lengths)}
    for length, k in subset_sum(left, rest).items():
        quota[place[length]] += k
    return quota


def placed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row with its source's ``key``, its ``size`` and, in ``o``, its place in the seeded order."""
    text = F.col("text").cast("string")
    place = F.struct(F.xxhash64(F.lit(SEED), "doc_id").alias("h"), F.col("doc_id").alias("i"), F.xxhash64(text).alias("t"))
    return docs.select(*columns, text_key(F.col("source")).alias("key"), size_of(text).alias("size"), place.alias("o"))


def plan(base: DataFrame) -> tuple[DataFrame, int, int]:
    """What the mix takes of the rows (source, key, size, o): one row for each length of a source, their number, and the number of rows.

    Columns: key, size, n (rows), base (copies of every row), quota (rows with one more), source_size, target,
    border (the last place with one more), tied and tied_in (rows at the border, and those of them taken).
    """
    counts = cut(base.groupBy("source", "key", "size").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))

    def choose(rows: pa.Table) -> pa.Table:
        lengths, n = rows.column("size").to_numpy(), rows.column("n").to_numpy()
        target, whole = rows.column("target")[0].as_py(), int((lengths * n).sum())
        times = min(MOST, int(target // whole)) if whole else 0
        quota = fit(lengths, n, round(target) - times * whole) if times < MOST else np.zeros(len(n), np.int64)
        some, same = lengths > 0, np.ones(len(n), np.int64)
        columns = [rows.column("key"), lengths, n, np.where(some, times, 0).astype(np.int32), np.where(some, quota, 0), same * whole, same * target]
        return pa.table(dict(zip(("key", "size", "n", "base", "quota", "source_size", "target"), columns, strict=True)))

    # One row for each length of a source: their number grows at most as the root of its words.
    schema = "key string, size long, n long, base int, quota long, source_size long, target double"
    quotas = counts.select("key", "size", "n").join(named.select(text_key(F.col("source")).alias("key"), "target"), "key").groupBy("key").applyInArrow(choose, schema)
    quotas = cut(quotas)
    listed = quotas.count()

    # Lengths of many rows are cut in slices of their seeded order; only the slice with the border is ranked.
    part = quotas.where("quota > 0 and quota < n").select("key", "size", "n", "quota", F.ceil(F.col("n") / SLICE).alias("slices"), F.col("n").alias("w"))
    unit = F.pmod(F.col("o.h"), F.lit(1 << 40)) / float(1 << 40)
    sliced = cut(spread(base.select("key", "size", "o"), part, ["key", "size"], "w", total, listed=listed).withColumn("slice", F.floor(unit * F.col("slices")).cast("long")).select("key", "size", "o", "slice", "quota"))
    each = sliced.groupBy("key", "size", "slice", "quota").agg(F.count("*").alias("n"))
    run = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    room = each.withColumn("room", F.col("quota") - F.coalesce(F.sum("n").over(run), F.lit(0))).where("room > 0 and room <= n").select("key", "size", F.col("slice").alias("edge"), "room", F.col("n").alias("w"))
    ranked = spread(sliced.select("key", "size", "o", "slice"), room, ["key", "size"], "w", total, listed=listed).where("slice = edge")
    places = ranked.groupBy("key", "size", "room", "o").agg(F.count("*").alias("tied"))
    upto = F.sum("tied").over(Window.partitionBy("key", "size").orderBy("o"))
    border = places.withColumn("upto", upto).where("upto >= room and upto - tied < room").select("key", "size", F.col("o").alias("border"), "tied", (F.col("room") - F.col("upto") + F.col("tied")).alias("tied_in"))
    return cut(quotas.join(border, ["key", "size"], "left")), listed, total


def decided(rows: DataFrame, chosen: tuple[DataFrame, int, int]) -> DataFrame:
    """``rows`` (..., key, size, o) with source_size, target and ``times``, how often the mix takes each."""
    lengths, listed, total = chosen
    whole = spread(rows, lengths.withColumn("w", F.col("n")), ["key", "size"], "w", total, listed=listed)
    more = F.when(F.col("quota") == 0, 0).when(F.col("quota") == F.col("n"), 1).when(F.col("o") < F.col("border"), 1).when(F.col("o") == F.col("border"), 1).otherwise(0)
    columns = [*rows.columns, "source_size", "target"]
    if lengths.where("tied_in < tied").isEmpty():
        return whole.select(*columns, (F.col("base") + more).alias("times"))
    # Rows alike in doc_id, source and text of which a part is taken: these few are told apart by rank.
    split = (F.col("o") == F.col("border")) & (F.col("tied_in") < F.col("tied"))
    nth = F.row_number().over(Window.partitionBy("key", "size").orderBy("o"))
    tied = whole.where(split).withColumn("times", F.col("base") + (nth <= F.col("tied_in")).cast("int"))
    return whole.where(~F.coalesce(split, F.lit(False))).select(*columns, (F.col("base") + more).alias("times")).unionByName(tied.select(*columns, "times"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) of every row; times is how often the mix takes it (0 to 2).

    Of a length, rows are taken in the order of a seeded hash of doc_id, then doc_id, then a hash of the text; rows alike in all of
    these are interchangeable. Null and blank texts have size 0 and are never taken; sources that are
    null form one source.
    """
    base = cut(placed(docs, F.col("doc_id"), F.col("source")))
    return decided(base, plan(base)).select("doc_id", "source", "size", "source_size", "target", "times")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken counts the words of all copies taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it.

    Rows are decided where they are read: sources of together at most ``common.LISTED`` lengths need no shuffle of texts.
    """
    chosen = plan(cut(placed(docs, F.col("source"))))
    rows = decided(placed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), chosen).where("times > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
