"""Pairs inside buckets of any size, in bounded blocks.

Rows that share a bucket are dealt into blocks of about ``BLOCK`` rows by a hash of their id, and
every pair of blocks becomes one group of at most two blocks. A hot bucket is thus spread over many
tasks, and no pair list is ever materialised: a group returns for each of its rows the number of
links found and one edge to the root of its linked set within the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_python, spread

BLOCK = 512


def crowded(rows: DataFrame, total: int) -> DataFrame:
    """Of ``total`` rows (bucket, id, ...) those of buckets with two rows or more, with the bucket's ``size``."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return spread(rows, sizes.withColumn("w", F.col("size")), ["bucket"], "w", total)


def alone(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, ...) of one bucket, the smallest, of those with the same members, with its ``size``."""
    members = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)"))
    lists = rows.groupBy("bucket").agg(F.count("*").alias("size"), members(1).alias("x"), members(2).alias("y"))
    once = lists.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"))
    return spread(rows, once.select("bucket", "size", F.col("size").alias("w")), ["bucket"], "w", rows.count())


def dealt(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Rows (bucket, size, id, ...) repeated for each pair of blocks (lo, hi) that they take part in.

    With the columns ``core`` and ``rest``, rows whose links with one another need no search and the number of the bucket's
    other rows, core rows have blocks of their own, which are paired with the blocks of the others only.
    """
    size, cored = block or BLOCK, "core" in rows.columns
    blocks = lambda n: F.ceil(n / size).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    if cored:
        first = blocks(F.col("rest"))
        own = rows.withColumns({"n": first + blocks(F.col("size") - F.col("rest")), "own": F.when(F.col("core"), first + spot(blocks(F.col("size") - F.col("rest")))).otherwise(spot(first)), "last": F.when(F.col("core"), first).otherwise(first + blocks(F.col("size") - F.col("rest")))}).where("last > 0")
    else:
        own = rows.withColumn("n", blocks(F.col("size"))).withColumns({"own": spot(F.col("n")), "last": F.col("n")})
    each = own.withColumn("far", F.explode(F.sequence(F.lit(0), F.col("last") - 1)))
    return each.withColumns({"lo": F.least("own", "far"), "hi": F.greatest("own", "far")}).drop("size", "n", "far", "last", "core", "rest")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in batches that are sorted by them. Only runs that cross batches are copied."""
    rest: list[pa.Table] = []
    key: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        cols = [now.column(k).to_numpy() for k in keys]
        change = np.zeros(now.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        at = [0, *(np.nonzero(change)[0] + 1).tolist(), now.num_rows]
        if rest and key != [c[0] for c in cols]:
            yield pa.concat_tables(rest).combine_chunks()
            rest = []
        for a, b in zip(at, at[1:], strict=False):
            if a:
                yield pa.concat_tables(rest).combine_chunks() if len(rest) > 1 else rest[0]
                rest = []
            rest.append(now.slice(a, b - a))
        key = [c[-1] for c in cols]
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def roots(link: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the index of the first row of each row's linked set."""
    n = len(link)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = link[i] & (root < 0)
        while front.any():
            root[front] = i
            front = link[front].any(0) & (root < 0)
    return root


def linked(rows: DataFrame, columns: list[str], link: Callable[[pa.Table], np.ndarray], weight: str | None = None, bucket: bool = False) -> DataFrame:
    """(id, links, root) for rows of ``dealt``: links and one edge of each row in each group.

    ``link`` gives the boolean matrix of links among the rows of one group; within a group of two
    blocks only links between the blocks count. ``weight`` is a column with the number of copies
    that a row stands for; ``bucket`` adds the bucket to the result.
    """
    keys = ["bucket", "lo", "hi"]
    names = ["id", "links", "root", *["bucket"][: int(bucket)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in names]
        held = 0
        for group in groups(batches, keys):
            if group.num_rows < 2:
                continue
            m = link(group)
            own = group.column("own").to_numpy()
            if own.min() != own.max():
                m &= own[:, None] != own[None, :]
            elif group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
                continue  # one of the two blocks is empty
            np.fill_diagonal(m, False)
            some = m.any(1)
            if not some.any():
                continue
            ids = group.column("id").to_numpy()
            count = m @ group.column(weight).to_numpy() if weight else m.sum(1)
            for x, v in zip(out, (ids[some], count[some], ids[roots(m)][some], group.column("bucket").to_numpy()[some])[: len(names)], strict=True):
                x.append(v.astype(np.int64))
            held += int(some.sum())
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                out, held = [[] for _ in names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    sent = rows.select(*keys, "own", "id", *columns)
    return in_python(sent.repartition(*keys).sortWithinPartitions(*keys), run, ", ".join(f"{x} long" for x in names))
