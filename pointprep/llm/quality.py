"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on counts over the whole text gives each document's evidence. The evidence of
all documents, with labels in its place where there are any, is summed by path within host and by
host. A host's rate is the posterior mean of a beta prior around the global rate, a path's that of one around
its host's rate; prior strengths come from the spread between hosts and between paths (method of
moments), so sparse sites shrink to what stands above them. A document's log-odds are its evidence,
moved by how far its path's rate is from the global one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, spread, text_key

#: Labelled rows that the classifier is fitted on: those with the smallest seeded hashes of their ids.
MAX_LABELLED = 20_000
SEED = 7
N_FEATURES = 12
#: Characters that prose has little of, as the inside of a character class.
ODD = r"!#$%&*+<=>@\[\\\]^_`{|}~"


def features(text: Column) -> Column:
    """Rates of counts over the whole text, as an array; zeros but for the constant and a mark if there is no word.

    Expressions alone, so that a row is scored wherever it is read. Sizes are bytes of UTF-8.
    """
    raw = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.octet_length(F.regexp_replace(raw, pattern, ""))
    without = lambda c: F.octet_length(F.replace(raw, F.lit(c), F.lit("")))

    def rates(x: Column) -> Column:
        words, lines, size = x["words"], x["lines"], x["size"]
        n = F.size(words)
        repeated = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.element_at(words, F.greatest(i, F.lit(1))))))
        return F.when(n == 0, F.array(*map(F.lit, [1.0, 1.0] + [0.0] * (N_FEATURES - 2)))).otherwise(
            F.array(
                F.lit(1.0),
                F.lit(0.0),
                F.least(F.lit(1.0), x["odd"] / n),
                F.least(F.lit(4.0), x["odd"] / n),
                x["upper"] / size,
                F.least(F.lit(1.0), x["calls"] / n),
                F.least(F.lit(1.0), x["bars"] / n),
                repeated / n,
                F.when(n > 1, F.log(F.size(F.array_distinct(words)).cast("double")) / F.log(F.greatest(n, F.lit(2)).cast("double"))).otherwise(1.0),
                F.least(F.lit(1.0), F.log1p(n.cast("double")) / 10),
                1.0 - F.size(F.array_distinct(lines)) / F.size(lines),
                F.least(F.lit(40.0), size / n) / 40,
            )
        )

    size = F.octet_length(raw)
    counts = {"odd": size - left(f"[{ODD}]+"), "upper": size - left("[A-Z]+"), "calls": size - without("!"), "bars": size - without("|")}
    words = F.filter(F.split(raw, r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")
    parts = F.struct(words.alias("words"), F.split(raw, "\n", -1).alias("lines"), size.alias("size"), *[c.alias(k) for k, c in counts.items()])
    return let(parts, rates)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method on columns scaled to unit spread."""
    scale = np.maximum(x.std(0), 1e-6)
    scale[0] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def strength(between: DataFrame, rate: str, prior: str, n: str) -> float:
    """Beta prior strength from how far groups' rates lie from their prior means beyond chance, by moments."""
    m, r, k = F.col(prior), F.col(rate), F.col(n)
    chance = m * (1 - m)
    groups, spread, noise, room = between.agg(F.count("*"), F.sum(k * (r - m) ** 2), F.sum(chance), F.sum(k * chance)).first()
    if not groups or not room or spread <= noise:
        return 1e4
    share = (spread - noise) / max(room - noise, 1e-9)  # intra-class correlation
    return min(1e4, max(1.0, 1 / share - 1))


class Fit(NamedTuple):
    """A fitted classifier: ``seen`` has (doc_id, host, path, logit, evidence) of every row, ``rates`` one row for each path with its rows in ``n``."""

    weights: np.ndarray
    base: float
    seen: DataFrame
    rates: DataFrame
    rows: int
    paths: int


def logit_of(x: Column, weights: np.ndarray) -> Column:
    """Log-odds of a document's own evidence, within bounds."""
    total = sum((F.element_at(x, i + 1) * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def fit(docs: DataFrame, labels: DataFrame, host: str, path: str, max_labelled: int) -> Fit:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    rows = cut(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), features(F.col("text").cast("string")).alias("x")))
    # A hash level lets about 1.3 times as many rows through as wanted, so that few reach the final sort.
    level = min(1.0, 1.3 * max_labelled / max(1, known.count()))
    h = F.xxhash64(F.lit(SEED), "doc_id")
    few = rows.where(F.pmod(h, F.lit(1 << 30)) < int(level * (1 << 30))).join(known, "doc_id")
    sample = few.select("x", "y", h.alias("h"), "doc_id").orderBy("h", "doc_id").limit(max_labelled).select("x", "y").toPandas()
    if sample["y"].nunique() < 2:
        weights = np.zeros(N_FEATURES)
    else:
        weights = logistic(np.array(sample["x"].tolist()), sample["y"].to_numpy(float))
    seen = rows.join(known, "doc_id", "left").select("doc_id", "host", "path", logit_of(F.col("x"), weights).alias("logit"), "y")
    seen = cut(seen.withColumn("evidence", 1 / (1 + F.exp(-F.col("logit")))))
    value = F.coalesce(F.col("y").cast("double"), F.col("evidence"))

    paths = cut(seen.groupBy("host", "path").agg(F.sum(value).alias("good"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    good, n = hosts.agg(F.sum("host_good"), F.sum("host_n")).first()
    base = min(1 - 1e-6, max(1e-6, (good or 0.0) / n if n else 0.5))
    spread_ = hosts.select((F.col("host_good") / F.col("host_n")).alias("r"), F.lit(base).alias("m"), F.col("host_n").alias("k"))
    a = strength(spread_, "r", "m", "k")
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + a * base) / (F.col("host_n") + a))
    above = hosts.select(F.col("host").alias("host_"), "host_rate")
    both = paths.join(above, F.col("host").eqNullSafe(F.col("host_"))).select("host", "path", "good", "n", "host_rate")
    b = strength(both.select((F.col("good") / F.col("n")).alias("r"), F.col("host_rate").alias("m"), F.col("n").alias("k")), "r", "m", "k")
    rate = (F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)
    rates = cut(both.select(text_key(F.col("host")).alias("host_key"), text_key(F.col("path")).alias("path_key"), "n", "host_rate", rate.alias("path_rate")))
    return Fit(weights, base, seen, rates, n or 0, rates.count())


def quality_of(fitted: Fit, logit: Column) -> Column:
    """Probability that a document is good, from its evidence and ``path_rate``."""
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    moved = logit + odds(F.col("path_rate")) - math.log(fitted.base / (1 - fitted.base))
    return 1 / (1 + F.exp(-moved)) if fitted.weights.any() else F.lit(0.5)


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, keep) of every row.

    evidence, the rates and quality are probabilities; keep is quality >= threshold. Null hosts and
    paths form groups of their own. Texts without a word get the classifier's verdict on an
    empty text. Labels that are repeated count once (the lower); without labels of both
    kinds evidence is 0.5 for all and all rows are kept. Rows with a null or repeated doc_id keep their own rows.
    """
    fitted = fit(docs, labels, host, path, max_labelled)
    keyed = fitted.seen.withColumns({"host_key": text_key(F.col("host")), "path_key": text_key(F.col("path"))})
    rated = spread(keyed, fitted.rates, ["host_key", "path_key"], "n", fitted.rows, listed=fitted.paths)
    return rated.select("doc_id", "evidence", "host_rate", "path_rate", quality_of(fitted, F.col("logit")).alias("quality")).withColumn("keep", F.col("quality") >= threshold)


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps.

    A row's verdict needs its text and its path's rate alone, so rows are decided where they are read:
    sites of together at most ``common.LISTED`` paths need no shuffle of texts.
    """
    fitted = fit(docs, labels, host, path, max_labelled)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    logit = let(features(F.col("text").cast("string")), lambda x: logit_of(x, fitted.weights))
    keyed = docs.select(row, text_key(F.col(host)).alias("host_key"), text_key(F.col(path)).alias("path_key"), logit.alias("logit"))
    rated = spread(keyed, fitted.rates, ["host_key", "path_key"], "n", fitted.rows, listed=fitted.paths)
    return rated.where(quality_of(fitted, F.col("logit")) >= threshold).select("row.*")
