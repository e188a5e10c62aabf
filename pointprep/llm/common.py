"""What the operators share: reading tables, cutting lineage, joins that no hot key slows, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: blank, tab, newline, vertical tab, form feed, return.
WORD = r"[^ \t\n\x0B\f\r]+"
#: Tables of at most so many rows are broadcast; of larger ones the keys that are hot, which are never more.
LISTED = 50_000
#: Rows that a key may have in a shuffle join before it counts as hot, while the input is small.
COOL = 256

#: Rows that go to a Python worker at once, where the session says nothing: texts can be long, and two such batches are held on either side.
ROWS_AT_ONCE = 1500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session on one
    machine takes a temporary folder; on a cluster, whose machines do not share one, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    out = df.checkpoint()
    made = _made.get()
    if made is not None and (path := path_of(out)):
        made.append(path)
    return out


def in_python(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in modest batches."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS, None) is None:
        conf.set(ARROW_ROWS, str(ROWS_AT_ONCE))
    return df.mapInArrow(run, schema)


def path_of(df: DataFrame) -> str | None:
    """Where ``cut`` has written ``df``."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def delete(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` has written of ``df``: only where all that reads it has itself been written."""
    if path := path_of(df):
        delete(df.sparkSession, [path])


@contextmanager
def written() -> Iterator[list[str]]:
    """The checkpoints made inside, in order."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identity(*cols: Column) -> tuple[Column, Column]:
    """128 bits in two longs for the values of ``cols`` and which of them are null: equal rows have equal ones, and of 1e10 rows no two others are likely to."""
    nulls = F.array(*[c.isNull() for c in cols])
    return F.xxhash64(F.lit(1), *cols, nulls), F.xxhash64(F.lit(2), nulls, *reversed(cols))


def text_key(c: Column) -> Column:
    """A key that is not null for a string that may be: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit(""))


def spread(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", listed: int | None = None) -> DataFrame:
    """``rows`` joined with ``side`` on ``on``, with no key's rows gathered in one task.

    ``side`` has one row a key and in ``weight``, which is dropped, how many of the ``total`` rows have that key.
    Keys with more than ``total / LISTED`` rows are broadcast: there are at most ``LISTED`` of them,
    whatever the size. The others meet by shuffle. A side of ``listed`` rows, if that is as few, is broadcast whole.
    """
    if listed is not None and listed <= LISTED:
        return rows.join(F.broadcast(side.drop(weight)), on, how)
    most = max(COOL, total // LISTED)
    hot = side.where(F.col(weight) > most).drop(weight).withColumn("hot_", F.lit(True))
    tagged = rows.join(F.broadcast(hot), on, "left")
    cool = tagged.where("hot_ is null").select(*rows.columns).join(side.where(F.col(weight) <= most).drop(weight), on, how)
    return tagged.where("hot_").drop("hot_").unionByName(cool)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star contraction until nothing changes: each round is two
    aggregations and two joins on the edge list, each written to the checkpoint folder in place of the one before. Nodes with many
    neighbours meet their smallest by ``spread``, so none has its neighbours gathered in one task.
    Self-loops and null ends are ignored; an empty edge list gives an empty result.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = state_of(e)
    while state[0]:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = cut(spread(both.where("v > u"), least, ["u"], "c", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: smaller neighbours of u, and u itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = (
            spread(large, low, ["u"], "c", state[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, e = e, cut(small)
        drop(before)
        drop(large)
        now = state_of(e)
        if state == now:
            break
        state = now
    pairs = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return pairs.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))


def state_of(e: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    return tuple(e.agg(F.count("*"), h(1), h(2)).first())


def named_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, component_id) of the nodes (id, least) in ``groups``: the smallest ``least`` of each component."""
    held = cut(nodes.join(groups.withColumnRenamed("node", "id"), "id"))
    names = held.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    return spread(held, names, ["component"], "c", held.count()).select("id", "component_id")
