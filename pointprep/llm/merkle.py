"""Merkle-tree fingerprints over paragraphs and sections, in Spark SQL alone.

From the leaves: pieces of ``PIECE`` code points counted from the start of each paragraph have their MD5; a paragraph (line) the SHA-256 of
its length and its pieces' digests; a section the SHA-256 of its paragraphs' digests; the root that of the sections' digests. A
section ends with a paragraph whose digest starts with 0 or 1, so it has about eight, and an inserted paragraph moves no other border.

A fingerprint is the tree in writing: ``root|section=paragraph,length,pieces:...paragraph,length,pieces;section=...`` with the root in full,
eight hex digits of each digest below it, ``;`` behind the last paragraph of a section and ``:`` behind others, lengths in
hex code points. Roots test equality. ``likeness`` and ``edits`` go down the branches that differ only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions

PIECE = 32
#: Lengths summed at a time where places are counted.
CHUNK = 256


def fingerprint(text: Column, piece: int = PIECE) -> Column:
    """Fingerprint of a string column; null counts as the empty text."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), F.md5)
        size = F.lower(F.hex(F.length(p)))
        return let(leaves, lambda x: let(F.sha2(F.concat(size, F.lit(","), F.array_join(x, "")), 256), lambda d: F.concat(d, F.lit(","), size, F.lit(","), F.array_join(F.transform(x, lambda y: F.substring(y, 1, 8)), ""), F.when(d < "2", ";").otherwise(":"))))

    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph)
    sections = F.filter(F.split(F.array_join(paragraphs, ""), "(?<=;)", -1), lambda s: s != "")
    # A paragraph's digest stands for its length and pieces, so a section hashes the digests alone.
    digests = lambda s: F.array_join(F.regexp_extract_all(s, F.lit("(?:^|:)([0-9a-f]{64})"), F.lit(1)), "")
    short = lambda s: F.regexp_replace(s, "(^|:)([0-9a-f]{8})[0-9a-f]{56},", "$1$2,")
    written = F.transform(sections, lambda s: let(F.sha2(digests(s), 256), lambda d: F.struct(d.alias("d"), F.concat(F.substring(d, 1, 8), F.lit("="), short(s)).alias("s"))))
    return let(written, lambda w: F.concat(F.sha2(F.array_join(w["d"], ""), 256), F.lit("|"), F.array_join(w["s"], "")))


def root_of(fp: Column) -> Column:
    return F.substring_index(fp, "|", 1)


def paragraphs_of(sections: Column) -> Column:
    """Paragraphs (digest, length, pieces as written) of an array of sections, in order."""
    return F.filter(F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "=", -1), "[:;]"))), lambda p: p != "")


def pieces_of(paragraphs: Column) -> Column:
    """Distinct digests of the pieces of an array of paragraphs."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring_index(p, ",", -1), F.lit("[0-9a-f]{8}"), F.lit(0)))))


def parsed(fp: Column) -> Column:
    """A fingerprint taken apart: its root, sections, and the distinct pieces of all its paragraphs."""
    sections = F.filter(F.split(F.substring_index(fp, "|", -1), "(?<=;)", -1), lambda s: s != "")
    return F.struct(root_of(fp).alias("root"), sections.alias("sections"), pieces_of(paragraphs_of(sections)).alias("pieces"))


def differing(a: Column, b: Column) -> Column:
    """Paragraphs of the tree ``a`` that ``b`` has not where their sections differ, once each."""
    own, other = F.array_except(a["sections"], b["sections"]), F.array_except(b["sections"], a["sections"])
    return F.array_except(paragraphs_of(own), paragraphs_of(other))


def likeness_of(a: Column, b: Column) -> Column:
    """As ``likeness``, of two ``parsed`` fingerprints."""
    alone = lambda x, y: F.size(F.array_except(pieces_of(differing(x, y)), y["pieces"]))
    total = F.size(a["pieces"]) + F.size(b["pieces"])
    share = let(F.struct((alone(a, b) + alone(b, a)).alias("apart"), total.alias("total")), lambda x: F.least(1.0 - x["apart"] / x["total"], 1.0 - 1.0 / (x["total"] + 1)))
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise(share)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints, from the fingerprints alone: 1 where roots are equal, else the Dice coefficient of
    their distinct pieces, kept below 1; pieces below equal sections and paragraphs are in both and not compared."""
    return let(F.struct(parsed(a).alias("a"), parsed(b).alias("b")), lambda x: likeness_of(x["a"], x["b"]))


def edits(a: Column, b: Column, piece: int = PIECE) -> Column:
    """Where the text of fingerprint ``a`` differs from that of ``b``: array of (start, end) in code points, end exclusive.

    One range for each piece of a differing paragraph that no differing paragraph of ``b`` has; for a paragraph without pieces an
    empty range. Nothing where roots are equal.
    """
    total = lambda x, at, n: F.aggregate(F.slice(x, at, n), F.lit(0), lambda s, y: s + y)
    part = lambda p, k: F.split(p, ",")[k]
    size = lambda p: F.conv(part(p, 1), 16, 10).cast("int")

    def ranges(x: Column) -> Column:
        sizes = F.transform(x["all"], lambda p: size(p) + 1)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["all"]) / CHUNK).cast("int")), lambda k: total(sizes, k * CHUNK + 1, F.lit(CHUNK)))
        known = pieces_of(x["other"])

        def one(p: Column, i: Column) -> Column:
            whole = F.floor(i / CHUNK).cast("int")
            start = total(blocks, F.lit(1), whole) + total(sizes, whole * CHUNK + 1, i % CHUNK)
            digests = F.regexp_extract_all(part(p, 2), F.lit("[0-9a-f]{8}"), F.lit(0))
            span = lambda s, k: F.struct((s + k * piece).alias("start"), F.least(s + (k + 1) * piece, s + size(p)).alias("end"))
            spans = lambda s: F.filter(F.transform(digests, lambda d, k: F.when(~F.array_contains(known, d), span(s, k))), lambda y: y.isNotNull())
            empty = lambda s: F.array(F.struct(s.alias("start"), s.alias("end")))
            return F.when(F.array_contains(x["own"], p), let(start, lambda s: F.when(size(p) == 0, empty(s)).otherwise(spans(s))))

        return F.flatten(F.filter(F.transform(x["all"], one), lambda y: y.isNotNull()))

    none = F.array().cast("array<struct<start:int,end:int>>")
    tree = lambda x: F.struct(paragraphs_of(x["a"]["sections"]).alias("all"), differing(x["a"], x["b"]).alias("own"), differing(x["b"], x["a"]).alias("other"))
    both = F.struct(parsed(a).alias("a"), parsed(b).alias("b"))
    return F.when(root_of(a) == root_of(b), none).otherwise(let(both, lambda x: let(tree(x), ranges)))


def below(borders: Column, n: int, value: Column) -> Column:
    """How many of ``n`` sorted ``borders`` are at most ``value``, by halving."""
    step = lambda s, _: F.when(s["lo"] < s["hi"], let(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), lambda m: F.when(F.element_at(borders, m + 1) <= value, F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))).otherwise(s)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda s: s["lo"])


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of ``docs`` in windows by range of doc_id, ordered by (doc_id, text), each followed by the row next to it: after the last comes the first.

    Rows with ``seen`` false stand at the end of a window for the first of the next; they are no rows of the
    table. Ranges are those of a range partitioning of the ids alone. The texts are shuffled once.
    """
    keyed = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    ranged = keyed.select("at").repartitionByRange(4 * partitions(docs.sparkSession), "at")
    firsts = sorted(r[1] for r in ranged.groupBy(F.spark_partition_id().alias("r")).agg(F.min("at")).collect())
    n = len(firsts)
    borders = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<long>")
    placed = keyed.withColumn("r", below(borders, n, F.col("at")) - 1)
    # The rows of each range's smallest doc_id also stand at the end of the range before.
    before = F.when(F.col("at") == F.element_at(borders, F.greatest(F.col("r"), F.lit(0)) + 1), F.array(F.struct(F.col("r").alias("r"), F.lit(True).alias("seen")), F.struct(F.pmod(F.col("r") - 1, F.lit(max(n, 1))).alias("r"), F.lit(False).alias("seen"))))
    both = placed.select(*docs.columns, "at", F.explode(F.coalesce(before, F.array(F.struct(F.col("r").alias("r"), F.lit(True).alias("seen"))))).alias("x")) if n else placed.withColumn("x", F.struct("r", F.lit(True).alias("seen")))
    both = both.select(*docs.columns, "at", "x.r", "x.seen")
    return both, Window.partitionBy("r").orderBy(F.col("seen").desc(), "at", F.col("text").asc_nulls_first())


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text keeps the first half of the text (the longer, if odd) and goes on with as many
    code points of the next document as were dropped, or all it has. Null texts count as empty; of
    rows that share a doc_id the one with the smaller text comes first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows, order = with_next(docs.select("doc_id", text.alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("following"), F.lit(1), half))
    # Trees are built behind the shuffle and looked up in the same windows.
    trees = (
        rows.withColumn("following", F.lead("text").over(order))
        .select("doc_id", "at", "text", "r", "seen", new.alias("new"))
        .select("doc_id", "at", "text", "r", "seen", F.length("text").cast("long").alias("n_chars"), F.sha2("new", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"))
    )
    pairs = trees.withColumn("next", F.lead("fingerprint").over(order)).where("seen")
    trees = F.struct(*[parsed(F.col(c)).alias(n) for c, n in (("fingerprint", "a"), ("edited_fingerprint", "e"), ("next", "n"))])
    near = let(trees, lambda x: F.struct(likeness_of(x["a"], x["e"]).alias("near_edited"), likeness_of(x["a"], x["n"]).alias("near_next")))
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near.near_edited", "near.near_next")
