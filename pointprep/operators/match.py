"""Matching of point names to labels: exact, ordered rules, token-set similarity, additive scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointprep.functions.text import contains_any, normalize, tokens

from .vocab import KEYWORDS, RULES, lookup, rules_in

#: Lookup tables of at most so many labels are broadcast; larger ones are joined by shuffle.
SMALL = 50_000


def sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def exact(names: DataFrame, vocab: DataFrame, n_labels: int) -> DataFrame:
    """``names`` with ``label`` where the normalised name (``norm``) is a key of the lookup."""
    return names.join(sized(lookup(vocab).withColumnRenamed("key", "norm"), 2 * n_labels), "norm", "left")


def rule(norm: Column, rules: list) -> Column:
    """struct(label, confidence) of the first rule that holds, in order of groups, then locations; null if none.

    Tests are substring tests. A group's default comes after its locations, before the next group.
    """
    out = None
    for keywords, places, default in rules:
        hit = contains_any(norm, keywords)
        for place, label in places:
            when = hit & F.contains(norm, F.lit(place))
            value = F.struct(F.lit(label).alias("label"), F.lit(0.85).alias("confidence"))
            out = F.when(when, value) if out is None else out.when(when, value)
        if default:
            value = F.struct(F.lit(default).alias("label"), F.lit(0.6).alias("confidence"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("struct<label:string,confidence:double>") if out is None else out


def jaccard(names: DataFrame, vocab: DataFrame, n_labels: int, least: float = 0.3, cap: float = 0.7) -> DataFrame:
    """(norm, label, confidence) for names (norm, distinct) whose best label has a token-set Jaccard of ``least`` or more.

    An inverted index: tokens are joined, shared ones counted; the first label wins ties.
    """
    mine = names.select("norm", F.array_distinct(tokens(F.col("norm"))).alias("t")).select("norm", F.size("t").alias("na"), F.explode("t").alias("token"))
    theirs = vocab.select("label", "label_id", F.array_distinct(tokens(normalize(F.col("label")))).alias("t")).select("label", "label_id", F.size("t").alias("nb"), F.explode("t").alias("token"))
    both = mine.join(sized(theirs, n_labels), "token").groupBy("norm", "label", "label_id", "na", "nb").agg(F.count("*").alias("n"))
    scored = both.withColumn("score", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("score") >= least)
    best = scored.groupBy("norm").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label_id"))).alias("b"))
    return best.select("norm", F.col("b.label").alias("label"), F.least(F.col("b.score"), F.lit(cap)).alias("confidence"))


def cascade(points: DataFrame, vocab: DataFrame, column: str = "clean_name", rules: list = RULES, min_confidence: float | None = None) -> DataFrame:
    """``points`` with ``label``, ``label_id`` and ``confidence``: exact (1.0), else rule (0.85, 0.6), else Jaccard (up to 0.7), else null and 0.0.

    Names are matched once per distinct normalised form. With ``min_confidence`` a weaker match keeps
    its row with null label and its confidence. The vocabulary's labels are gathered to filter the rules: labels are a dimension.
    """
    wanted = {lab for _, at, d in rules for lab in [*(x for _, x in at), d] if lab}
    n = vocab.count()
    present = {r[0] for r in vocab.where(F.col("label").isin(sorted(wanted))).select("label").collect()}
    keyed = points.withColumn("norm", normalize(F.col(column)))
    names = keyed.where("norm is not null").select("norm").distinct()
    first = exact(names, vocab, n).withColumn("r", rule(F.col("norm"), rules_in(present, rules)))
    first = first.select("norm", F.coalesce("label", "r.label").alias("label"), F.when(F.col("label").isNotNull(), 1.0).otherwise(F.col("r.confidence")).alias("confidence"))
    rest = jaccard(first.where("label is null").select("norm"), vocab, n).toDF("norm", "l3", "c3")
    all_ = first.join(rest, "norm", "left").select("norm", F.coalesce("label", "l3").alias("label"), F.coalesce("confidence", "c3", F.lit(0.0)).alias("confidence"))
    out = keyed.join(all_, "norm", "left").join(sized(vocab, n), "label", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    if min_confidence is not None:
        weak = F.col("confidence") < min_confidence
        out = out.withColumns({"label": F.when(~weak, F.col("label")), "label_id": F.when(~weak, F.col("label_id"))})
    return out.select(*points.columns, "label", "label_id", "confidence")


def additive(points: DataFrame, vocab: DataFrame, column: str = "clean_name", least: float = 0.5, cap: float = 0.9, keywords: dict = KEYWORDS) -> DataFrame:
    """``points`` with ``label`` and ``confidence`` of the additive keyword scorer: exact match 1.0, else the best label by

    sum over words of [word in label] + 0.5 for each part of each keyword in the word that is in the label,
    over the number of words. Words are scored once each.
    """
    n = vocab.count()
    keyed = points.withColumn("norm", normalize(F.col(column)))
    names = exact(keyed.where("norm is not null").select("norm").distinct(), vocab, n)
    words = names.where("label is null").select("norm", tokens(F.col("norm")).alias("t")).select("norm", F.size("t").alias("n"), F.explode("t").alias("word"))
    small = vocab.select("label", "label_id", F.lower("label").alias("low"))
    at = F.sequence(F.lit(1), F.length("low"))
    parts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(i, F.length("low")), lambda j: F.substring(F.col("low"), i, j - i + 1))))
    # Words inside labels are found by an index of the labels' substrings, keywords by an index of keywords.
    inside = small.where("low <> ''").select("label", "label_id", F.explode(F.array_distinct(parts)).alias("word"), F.lit(1.0).alias("s"))
    spark = vocab.sparkSession
    table = spark.createDataFrame([(k, part.lower()) for k, ps in keywords.items() for part in ps], "keyword string, part string")
    spoken = small.join(F.broadcast(table), F.contains("low", F.col("part"))).groupBy("label", "label_id", "keyword").agg(F.sum(F.lit(0.5)).alias("s"))
    distinct = words.select("word").distinct()
    heard = distinct.select("word", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("word"), k))).alias("keyword"))
    per_word = distinct.join(inside, "word").select("word", "label", "label_id", "s").union(heard.join(sized(spoken, n), "keyword").select("word", "label", "label_id", "s"))
    total = words.join(per_word, "word").groupBy("norm", "n", "label", "label_id").agg(F.sum("s").alias("s")).withColumn("score", F.col("s") / F.col("n"))
    best = total.groupBy("norm").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label_id"))).alias("b")).where(F.col("b.score") >= least)
    found = names.join(best, "norm", "left").select("norm", F.coalesce("label", "b.label").alias("label"), F.when(F.col("label").isNotNull(), 1.0).when(F.col("b.score").isNotNull(), F.least(F.col("b.score"), F.lit(cap))).otherwise(0.0).alias("confidence"))
    return keyed.join(found, "norm", "left").select(*points.columns, "label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


class LabelMatcher:
    """A vocabulary (label, label_id) with its rules, to match many tables: the cascade or the additive scorer."""

    def __init__(self, vocab: DataFrame, rules: list = RULES, keywords: dict = KEYWORDS):
        self.vocab, self.rules, self.keywords = vocab, rules, keywords

    def match(self, points: DataFrame, column: str = "clean_name", min_confidence: float | None = None) -> DataFrame:
        return cascade(points, self.vocab, column, self.rules, min_confidence)

    def score(self, points: DataFrame, column: str = "clean_name") -> DataFrame:
        return additive(points, self.vocab, column, keywords=self.keywords)
