"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Signs of a vector against ``bits`` random hyperplanes make one key of one table. Two vectors of
cosine c agree on one sign with probability p = 1 - arccos(c)/pi, so on a key with p**bits and on at
least one of T keys with 1 - (1 - p**bits)**T. ``bits`` follows from the largest label's row count
(about 32 vectors meet by chance in a bucket, at any size), T from the recall asked for at the
threshold itself; pairs above it are found more surely.

A posting carries ``SKETCH`` more signs and no vector: members of a bucket go on only if theirs differ from
another's in few enough places. Buckets in which the same members go on are one. What is left is verified
by the exact cosine in double precision, block by block; a pair that meets in several tables counts in the first.
Components come from one edge of each member and block to its group's root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import alone, dealt, linked
from .common import LISTED, components, cut, identity, named_groups, spread

SEED = 20240607
#: Signs of a posting, and the deviations beyond the expected differences at the threshold that still pass.
SKETCH, LOOSE = 128, 5.0
#: Members of a bucket compared with one another in one block.
BLOCK = 1024
#: A bucket's number: the table above, a hash below.
LOW = (1 << 53) - 1


def plan(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a key, tables) for a largest label of so many vectors."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(2, largest))) - 5))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def most_differences(threshold: float) -> int:
    q = math.acos(threshold) / math.pi
    return int(SKETCH * q + LOOSE * math.sqrt(SKETCH * q * (1 - q)))


def near_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, id) of rows that differ in at most ``most`` signs from another row of their group.

    Rows (bucket, pair, id, s1, s2) come sorted by bucket and pair of blocks. Members of the second block of a pair
    have the complement of their id; two of them are not compared.
    """
    rest: list[np.ndarray] | None = None

    def held(cols: list[np.ndarray]) -> pa.RecordBatch:
        bucket, pair, ids = cols[:3]
        a, b = cols[3].view(np.uint64), cols[4].view(np.uint64)
        hit = np.zeros(len(ids), bool)
        at, d = np.arange(len(ids)), 0
        while len(at):  # rows of a group lie together: each is compared with the d-th behind it
            d += 1
            at = at[at < len(ids) - d]
            at = at[(bucket[at] == bucket[at + d]) & (pair[at] == pair[at + d])]
            near = np.bitwise_count(a[at] ^ a[at + d]).astype(np.int16) + np.bitwise_count(b[at] ^ b[at + d]) <= most
            near &= (ids[at] >= 0) | (ids[at + d] >= 0)
            hit[at[near]] = hit[at[near] + d] = True
        ids = np.where(ids < 0, ~ids, ids)
        return pa.RecordBatch.from_arrays([pa.array(bucket[hit]), pa.array(ids[hit])], ["bucket", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        last = int(np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0].max(initial=-1)) + 1
        if last:
            yield held([c[:last] for c in now])
        rest = [c[last:] for c in now]
    if rest is not None:
        yield held(rest)


def candidates(postings: DataFrame, total: int, most: int) -> DataFrame:
    """(bucket, id) of the postings (bucket, id, s1, s2) with a near one in their bucket; buckets of any size, in pairs of blocks."""
    sizes = postings.groupBy("bucket").agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > BLOCK))
    n = large.count()
    if n <= LISTED:
        sized = postings.join(F.broadcast(large), "bucket", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    else:
        sized = spread(postings, sizes.withColumn("w", F.col("size")), ["bucket"], "w", total)
    blocks = dealt(sized, BLOCK)
    sent = blocks.select("bucket", (F.col("lo").cast("long") * (1 << 31) + F.col("hi")).alias("pair"), F.when(F.col("own") > F.col("lo"), F.expr("~id")).otherwise(F.col("id")).alias("id"), "s1", "s2")
    run = lambda batches: near_rows(batches, most)
    return sent.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(run, "bucket long, id long").distinct()


def key_of(rows: DataFrame) -> list[Column]:
    return [c.alias(n) for c, n in zip(identity(F.col("label"), F.col("embedding")), ("k1", "k2"), strict=True)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.998) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows link only where labels are equal and not null and the cosine reaches ``threshold``. Null,
    empty or zero vectors, and those with null or non-finite components, link with nothing, nor do
    vectors of different lengths. Equal vectors of one label are one node with a count, so copies
    cost nothing; rows with a repeated vec_id are rows of their own.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    sound = F.expr("embedding is not null and size(embedding) > 0 and label is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    held = rows.where(F.coalesce(sound, F.lit(False)))
    most_of = held.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    bits, tables = plan(most_of[0] or 0, threshold, recall)
    width = (bits + 7) // 8

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, sketch = [], np.empty((batch.num_rows, 2), np.int64)
            lists = batch.column(2)
            for i in range(batch.num_rows):
                v = lists[i].values.to_numpy().astype(np.float64)
                if len(v) not in known:
                    known[len(v)] = planes(len(v), bits * tables + SKETCH)
                up = (v / np.abs(v).max()) @ known[len(v)] > 0
                keys.append(np.packbits(up[: bits * tables].reshape(tables, bits), axis=1).tobytes())
                sketch[i] = np.packbits(up[bits * tables :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["k1", "k2", "embedding", "place", "least", "copies", "signs", "s1", "s2"])

    # Equal vectors of a label are combined before they are shuffled.
    once = held.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    sent = once.select(*key_of(once), "embedding", F.xxhash64("label", F.size("embedding")).alias("place"), "least", "copies")
    signed = sent.mapInArrow(signs, f"k1 long, k2 long, embedding {kind}, place long, least long, copies long, signs binary, s1 long, s2 long")
    # Numbered where they are written: the number is the node.
    nodes = cut(signed.select("*", F.monotonically_increasing_id().alias("id")))
    count = nodes.count()
    bucket = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.shiftleft(t.cast("long"), 53).bitwiseOR(F.xxhash64("place", F.substring("signs", t * width + 1, F.lit(width))).bitwiseAND(F.lit(LOW))))
    postings = nodes.select("id", "s1", "s2", F.explode(bucket).alias("bucket"))
    near = cut(candidates(postings, tables * count, most_differences(threshold)))
    met = alone(near).join(nodes.select("id", "embedding", "place", "copies", "signs"), "id")

    def link(group: pa.Table) -> np.ndarray:
        parts = [x.values.to_numpy() for x in group.column("embedding")]
        v = np.zeros((len(parts), max(map(len, parts))))
        for i, x in enumerate(parts):
            v[i, : len(x)] = x
        v /= np.abs(v).max(1)[:, None]
        v /= np.sqrt((v * v).sum(1))[:, None]
        m = v @ v.T >= threshold
        np.fill_diagonal(m, False)
        # A pair counts in the first table in which its signs are the same.
        t = group.column("bucket")[0].as_py() >> 53
        place = group.column("place").to_numpy()
        s = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(len(v), tables, width)[:, : t + 1]
        i, j = np.nonzero(m)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            same = (s[a] == s[b]).all(2)
            m[a, b] = same[:, t] & ~same[:, :t].any(1) & (place[a] == place[b])
        return m

    found = cut(linked(dealt(met), ["embedding", "place", "copies", "signs"], link, "copies"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = named_groups(nodes.select("id", "least"), groups)
    results = cut(
        nodes.select("k1", "k2", "id", "copies", "least").join(counts, "id", "left").join(named, "id", "left")
        .select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    keyed = rows.withColumn("sound_", F.coalesce(sound, F.lit(False)))
    alone_ = keyed.where(~F.col("sound_")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = spread(keyed.where("sound_").select("vec_id", *key_of(keyed)), results, ["k1", "k2"], "copies", most_of[1] or 0)
    return joined.select("vec_id", "n_links", "component_id").unionByName(alone_).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
