"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight
bytes, so they share at least six positional bytes, and of the four two-byte blocks at least two.
Posting lists are therefore keyed by two whole blocks (four positional bytes with their place):
six postings a fingerprint, 32 bits of selectivity each. Inside a list, pairs are tallied by
shared positional bytes; those with fewer than six are dropped and the rest verified bit by bit.
Lists over ``SPLIT`` members are not paired: there each member meets the others through the keys
"remaining 32 bits with at most one bit flipped", which two members share exactly if they differ
in at most two bits; a star per key keeps the same connectivity in linear size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import alone, crowded, dealt, linked
from .common import components, cut, identity, in_python, named_groups, spread

SEED = 42
SPLIT = 128
BLOCKS = list(combinations(range(4), 2))


def shingle_hashes(text: str | None, shingle: int, xxh) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` lower-cased words; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxh(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([xxh(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps = [majority(shingle_hashes(x.as_py(), shingle, xxh64_intdigest)) for x in batch.column(1)]
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, fp long")


def block(fp: str, i: int) -> str:
    return f"(shiftrightunsigned({fp}, {48 - 16 * i}) & 65535)"


def shared_bytes(a: str, b: str) -> str:
    """SQL for the number of positions at which two fingerprints have the same byte."""
    return "(" + " + ".join(f"cast((shiftrightunsigned({a} ^ {b}, {s}) & 255) = 0 as int)" for s in range(0, 64, 8)) + ")"


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(fp, other): fingerprints of the distinct ones in ``fps`` at 1 or 2 differing bits.

    Complete for lists up to ``split`` members; longer lists give a star for each group of
    members within two bits of each other, so components are the same.
    """
    keys = [f"named_struct('n', {n}, 'k', {block('fp', i)} << 16 | {block('fp', j)})" for n, (i, j) in enumerate(BLOCKS)]
    postings = fps.select("fp", F.expr(f"inline(array({', '.join(keys)}))"))
    lists = postings.groupBy("n", "k").agg(F.count("*").alias("size")).where("size > 1")
    held = cut(postings.join(lists, ["n", "k"]))
    short = held.where(F.col("size") <= split)
    a, b = short.select("n", "k", F.col("fp").alias("a")), short.select("n", "k", F.col("fp").alias("b"))
    # A pair is taken from the first list that it shares.
    earlier = " or ".join(
        f"(n = {n} and not ({' or '.join(f'({block("a ^ b", p)} = 0 and {block("a ^ b", q)} = 0)' for p, q in BLOCKS[:n]) or 'false'}))" for n in range(6)
    )
    pairs = a.join(b, ["n", "k"]).where(f"a < b and {shared_bytes('a', 'b')} >= 6 and bit_count(a ^ b) <= 2 and ({earlier})").select(F.col("a").alias("fp"), F.col("b").alias("other"))
    flips = ", ".join(["0L"] + [f"{1 << s}L" for s in range(32)])
    rest = " ".join(f"when n = {n} then " + " | ".join(f"{block('fp', x)} << {16 * (1 - m)}" for m, x in enumerate(sorted({0, 1, 2, 3} - {i, j}))) for n, (i, j) in enumerate(BLOCKS))
    long_ = held.where(F.col("size") > split).withColumn("rest", F.expr(f"case {rest} end"))
    near = long_.select("n", "k", "fp", F.explode(F.expr(f"transform(array({flips}), x -> rest ^ x)")).alias("near"))
    hubs = near.groupBy("n", "k", "near").agg(F.min("fp").alias("other"), F.max("fp").alias("top")).where("other < top").drop("top")
    stars = near.join(hubs, ["n", "k", "near"]).where("fp <> other").select("fp", "other").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most two bits. Null and empty
    texts have fingerprint zero and link like any other; repeated rows keep their number; a null
    doc_id keeps its row and belongs to the component of its fingerprint.
    """
    fps = cut(fingerprints(docs, shingle))
    # Equal fingerprints are one node: groups of copies shrink before any join.
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")))
    edges = links(nodes.select("fp")).toDF("a", "b")
    grouped = named_groups(nodes.select(F.col("fp").alias("id"), "least"), components(edges)).withColumnRenamed("id", "fp")
    named = cut(nodes.join(grouped, "fp", "left").select("fp", "c", F.coalesce("component_id", "least").alias("component_id")))
    return spread(fps, named, ["fp"], "c", fps.count()).select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Wide fingerprints for the similarity of whole documents: bits, and the tables of sampled fingerprints that index them.
WIDE, TABLES, SAMPLE = 512, 12, 3
MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(32)], np.uint64)


def mixed(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th pseudo-random function of 64-bit hashes."""
    y = x ^ MIX[i]
    y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(31))


def wide_bits(hashes: np.ndarray) -> bytes:
    """SimHash of ``WIDE`` bits over distinct shingle hashes: 64 at a time from one mixing each."""
    return b"".join(majority(mixed(hashes, i)).to_bytes(8, "big") for i in range(WIDE // 64))


def sampled(hashes: np.ndarray) -> list[int]:
    """For each table the SimHash of the SAMPLE shingles that come first in the table's order."""
    out = []
    for t in range(TABLES):
        order = mixed(hashes, 16 + t)
        few = hashes[np.argpartition(order, SAMPLE - 1)[:SAMPLE]] if len(hashes) > SAMPLE else hashes
        out.append(majority(few) ^ int(MIX[t]))
    return out


def bits_for(similarity: float, margin: float = 2.2) -> int:
    """Hamming distance that WIDE-bit fingerprints of sets of this Jaccard similarity keep within, but for about one in seventy."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(WIDE * p + margin * (WIDE * p * (1 - p)) ** 0.5)


#: Sets of at least this many shingles are compared by wide fingerprint before their exact similarity; margin of that filter.
MANY, LOOSE = 64, 5.0
#: Columns of the incidence matrix and hashes held at a time, and rows of a block when sets are compared.
COLUMNS, HELD, SETS = 2048, 400_000, 256


def distinct_hashes(text: str | None, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.unique(shingle_hashes(text, shingle, xxh64_intdigest))


def near_pairs(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of wide fingerprints (rows of bytes) may reach ``similarity``: sizes allow it, and those of large sets are not far apart."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    same = (1 - p) ** 8
    least = max(1, int(WIDE // 8 * same - LOOSE * (WIDE // 8 * same * (1 - same)) ** 0.5))
    small, large = np.minimum(sizes_a, sizes_b), np.maximum(sizes_a, sizes_b)
    fit = small >= similarity * large - 1e-9
    test = fit & (small >= MANY)
    near = test.copy()
    other = b[test] if len(b) > 1 else b
    near[test] = (a[test] == other).sum(1) >= least
    other = b[near] if len(b) > 1 else b
    near[near] = np.bitwise_count(a[near].view(np.uint64) ^ other.view(np.uint64)).sum(1) <= bits_for(similarity, LOOSE)
    return near | fit & ~test


def wide_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), WIDE // 8)


def candidates(wide: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The matrix of ``near_pairs`` among rows."""
    out = np.zeros((len(wide), len(wide)), bool)
    for i in range(len(wide)):
        out[i] = near_pairs(wide, wide[i : i + 1], sizes, sizes[i : i + 1], similarity)
    return out


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Pairs of sets (sorted hashes) whose Jaccard similarity reaches ``similarity``, by the exact sizes of their intersections.

    Ranges of the hashes are counted one after the other, so memory does not grow with the sets.
    """
    sizes = np.array([len(x) for x in sets])
    parts = 1 + int(sizes.sum()) // HELD
    borders = np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(x, borders).tolist(), len(x)] for x in sets]
    both = np.zeros((len(sets), len(sets)))
    for p in range(parts):
        part = [x[c[p] : c[p + 1]] for x, c in zip(sets, cuts, strict=True)]
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in part])
        _, column, times = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        # Only hashes of several sets count in intersections.
        place = np.cumsum(times > 1) - 1
        held = times[column] > 1
        row, column = row[held], place[column[held]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[row[a:b], column[a:b] - at] = 1
            both += m @ m.T
    np.fill_diagonal(both, sizes)
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9


#: Keys of rows, of so many bytes with their place in a hash table, that are broadcast at most (some 20 MB).
KEYS = 200_000


def row_key(docs: DataFrame) -> list[Column]:
    """Columns k1 and k2 for all columns' values: rows with equal keys are copies of one row. Maps, which have no hash, count by their JSON form."""
    column = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return [c.alias(n) for c, n in zip(identity(*map(column, docs.schema.fields)), ("k1", "k2"), strict=True)]


def marked(rows: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with ``n`` distinct ``keys``: without a shuffle of rows for up to ``KEYS`` of them."""
    return rows.join(F.broadcast(keys) if n <= KEYS else keys, ["k1", "k2"], how)


def grouped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(k1, k2, doc_id, wide, root, component_id) of every row: groups of documents whose shingle sets resemble each other.

    ``k1`` and ``k2`` are the ``row_key``; ``root`` tells the groups apart, which ``component_id``, the smallest doc_id,
    does not where rows of several groups share a doc_id or have none.

    Two documents are linked if the Jaccard similarity of their shingle sets reaches ``similarity``.
    Those of similarity 0.8 differ in 5 to 14 of 64 SimHash bits, too many for any byte to
    be sure to agree. So each document has a wide fingerprint, and ``TABLES`` positional keys that are
    SimHashes of shingles sampled by minimum order; equal keys collide with probability similarity**SAMPLE
    each. Inside a list, pairs are candidates by the sizes of their sets and, for large sets, by shared
    bytes and Hamming distance of the wide fingerprints with a wide margin. The sets of rows with a
    candidate are then compared exactly. Lists of any size are paired in blocks; equal sets are one node. Documents without a word link with each other only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            own, wide, keys, sizes = [], [], [], []
            for x in batch.column(3):
                h = distinct_hashes(x.as_py(), shingle)
                own.append(xxh3_128_digest(h.tobytes()))
                wide.append(wide_bits(h))
                keys.append(np.array(sampled(h) if len(h) else [], np.uint64).view(np.int64))
                sizes.append(len(h))
            lists = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary()), pa.array(wide, pa.binary()), pa.array(sizes, pa.int32()), lists], ["k1", "k2", "doc_id", "set_id", "wide", "shingles", "keys"])

    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.select(*row_key(docs), "doc_id", text.alias("text"))
    rows = cut(in_python(sent, run, f"k1 long, k2 long, doc_id {kind}, set_id binary, wide binary, shingles int, keys array<long>"))
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"), F.min(F.struct("k1", "k2", "wide", "shingles", "keys")).alias("x"))
    # Numbered where they are written: the number is the node, so no two sets can be taken for one.
    nodes = cut(sets.select(F.monotonically_increasing_id().alias("id"), "set_id", "least", "c", "x.*"))
    # Written once: what follows reads postings more than once.
    postings = cut(nodes.select("id", F.explode("keys").alias("bucket")))
    shared = cut(crowded(postings, postings.count()))
    met = shared.join(nodes.select("id", "wide", "shingles"), "id")
    repeated = rows.select("k1", "k2").distinct().count() < rows.count()

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, set) of the distinct ``ids``."""

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [distinct_hashes(x.as_py(), shingle).tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

        owners = cut(nodes.join(ids, "id", "left_semi").select("k1", "k2", "id"))
        texts = docs.select(*row_key(docs), text.alias("text")).join(F.broadcast(owners) if owners.count() <= KEYS else owners, ["k1", "k2"]).select("id", "text")
        held = in_python(texts, gather, "id long, set binary")
        # Rows that are copies of one another have the same set; they are combined where they are read.
        return held.groupBy("id").agg(F.first("set").alias("set")) if repeated else held

    def near(group: pa.Table) -> np.ndarray:
        return candidates(wide_rows(group.column("wide")), group.column("shingles").to_numpy(), similarity)

    def link(group: pa.Table) -> np.ndarray:
        return alike([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")], similarity)

    largest = shared.agg(F.max("size")).first()[0] or 0
    met, stars = cored(met, sets_of, similarity) if largest > blocks.BLOCK else (met, None)
    # Lists with the same members give the same pairs: one of them is enough.
    flags = ["core", "rest"] if "core" in met.columns else []
    open_ = cut(linked(dealt(met), ["wide", "shingles"], near, bucket=True).select("bucket", "id").distinct())
    lists = alone(open_)
    if flags:
        known = met.where("core").select("bucket", "id", "core")
        lists = cut(lists.join(known, ["bucket", "id"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
        others = lists.groupBy("bucket").agg(F.count_if(~F.col("core")).cast("int").alias("rest"), F.count("*").alias("w"))
        lists = spread(lists, others, ["bucket"], "w", lists.count())
    found = linked(dealt(lists.join(sets_of(open_.select("id").distinct()), "id"), SETS), ["set"], link)
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    groups = components(edges.union(stars) if stars is not None else edges)
    roots = cut(nodes.join(groups.withColumnRenamed("node", "id"), "id", "left").select("set_id", "least", "c", F.coalesce("component", "id").alias("root")))
    total = roots.count()
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
    named = cut(spread(roots, names, ["root"], "w", total))
    return spread(rows.select("k1", "k2", "doc_id", "wide", "set_id"), named.select("set_id", "c", "root", "component_id"), ["set_id"], "c", rows.count()).drop("set_id")


def cored(met: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> tuple[DataFrame, DataFrame]:
    """(``met`` with core and rest, edges a, b). In lists of more than a block, core rows are those that reach ``similarity`` with the first row.

    They are linked through it, so a large group of near copies is compared with one of its rows and not with itself. Rows
    outside the core are ``rest`` in number and meet all rows of their list.
    """
    large = cut(met.where(F.col("size") > blocks.BLOCK).select("bucket", "size", "id", "wide", "shingles"))
    total = large.count()
    first = large.groupBy("bucket").agg(F.min(F.struct("id", "wide", "shingles")).alias("x"), F.count("*").alias("w"))
    first = cut(first.select("bucket", F.col("x.id").alias("hub"), F.col("x.wide").alias("hub_wide"), F.col("x.shingles").alias("hub_shingles"), "w"))
    paired = spread(large, first, ["bucket"], "w", total)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, hubs = batch.column(0), batch.column(1)
                near = near_pairs(wide_rows(batch.column(2)), wide_rows(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([ids, hubs], ["id", "hub"]).filter(pa.array(near))

    tested = paired.where("id <> hub").select("id", "hub", "wide", "hub_wide", "shingles", "hub_shingles").mapInArrow(test, "id long, hub long")
    pairs = cut(tested.distinct())
    n = pairs.groupBy("hub").agg(F.count("*").alias("w")).withColumn("n", F.ceil(F.col("w") / SETS).cast("int"))
    placed = cut(spread(pairs, n, ["hub"], "w", pairs.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).select("id", "hub", "block"))
    sets = cut(sets_of(placed.select("id").union(placed.select(F.col("hub").alias("id"))).distinct()))
    # Each block of a hub's rows has the hub's own set at its head.
    members = placed.join(sets, "id").select("hub", "block", F.lit(1).alias("head"), "id", "set")
    heads = placed.select("hub", "block").distinct().join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", "block", F.lit(0).alias("head"), F.col("hub").alias("id"), "set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = None, None
        for batch in batches:
            out = []
            for hub, block, is_member, i, x in zip(*[batch.column(c) for c in ("hub", "block", "head", "id", "set")], strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                if not is_member.as_py():
                    head, key = own.copy(), (hub.as_py(), block.as_py())
                    continue
                assert key == (hub.as_py(), block.as_py())
                both = len(np.intersect1d(own, head, assume_unique=True))
                if both >= similarity * (len(own) + len(head) - both) - 1e-9:
                    out.append((i.as_py(), hub.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], ["id", "hub"])

    sent = members.union(heads).repartition("hub", "block").sortWithinPartitions("hub", "block", "head")
    stars = cut(in_python(sent, verify, "id long, hub long"))
    marked_ = paired.select(*large.columns, "hub").join(stars.withColumn("core", F.lit(True)), ["id", "hub"], "left")
    marked_ = cut(marked_.withColumn("core", F.coalesce("core", F.col("id") == F.col("hub"))).drop("hub"))
    others = marked_.groupBy("bucket").agg(F.count_if(~F.col("core")).cast("int").alias("rest"), F.count("*").alias("w"))
    small = met.where(F.col("size") <= blocks.BLOCK).withColumns({"core": F.lit(False), "rest": F.col("size").cast("int")})
    return small.unionByName(spread(marked_, others, ["bucket"], "w", total)), stars.select(F.col("id").alias("a"), F.col("hub").alias("b"))


def resembling(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, wide, component_id) of every row: the groups of ``grouped``."""
    return grouped(docs, shingle, similarity).select("doc_id", "wide", "component_id")


def unique(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``grouped``: that with the smallest doc_id (null last), and of rows that share it that with the smallest key.

    Rows that go, and rows that are repeated, are known by their keys; up to ``KEYS`` of them no text is
    shuffled, beyond that each text once.
    """
    rows = cut(grouped(docs, shingle, similarity).groupBy("root", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c")))
    firsts = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    left = cut(rows.join(firsts.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").select("k1", "k2", "stays", "c"))
    gone, copied = left.where("stays is null or c > 1").select("k1", "k2"), left.where("stays and c > 1").select("k1", "k2")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(*row_key(docs), row.alias("row"))
    out = marked(keyed, gone, gone.count(), "left_anti")
    if n := copied.count():
        # Copies of a row become one where they are read, so no key is hot in the shuffle.
        once = marked(keyed, copied, n, "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
        out = out.unionByName(once)
    return out.select("row.*")
