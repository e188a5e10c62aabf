"""Classification metrics from (actual, predicted) pairs: one aggregation by pair, then small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) over the union of actual and predicted labels; 0 for 0/0."""
    counts = pairs.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("pred"), F.col("n").alias("support")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("support")))))
    s = sides.where("label is not null").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("support").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return s.select(
        "label", "tp", (F.col("pred") - tp).alias("fp"), (F.col("support") - tp).alias("fn"), "support",
        ratio(tp, F.col("pred")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), ratio(2.0 * tp, F.col("pred") + F.col("support")).alias("f1"),
    )


def summary(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, f1_weighted, f1_macro, f1_micro."""
    c = per_class(pairs, actual, predicted)
    n = F.sum("support")
    micro = 2.0 * F.sum("tp") / (2.0 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    return c.agg(n.alias("n"), (F.sum("tp") / n).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"), F.avg("f1").alias("f1_macro"), micro.alias("f1_micro"))


def report(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support): a row for each class, then ``macro avg`` and ``weighted avg``."""
    c = per_class(pairs, actual, predicted).withColumn("label", F.col("label").cast("string"))
    n = F.sum("support")
    rows = ["precision", "recall", "f1"]
    macro = c.agg(F.lit("macro avg").alias("label"), *[F.avg(x).alias(x) for x in rows], n.alias("support"))
    weighted = c.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(x) * F.col("support")) / n).alias(x) for x in rows], n.alias("support"))
    return c.select("label", *rows, "support").unionByName(macro).unionByName(weighted)


def best_checkpoint(epochs: DataFrame, metric: str = "f1_weighted", patience: int = 3, keep: int = 2) -> DataFrame:
    """``epochs`` (epoch, metric) with best, stopped (early stop after ``patience`` epochs without gain) and kept (the best and the latest).

    Epochs are few by nature; the window is over them alone.
    """
    from pyspark.sql import Window

    order = Window.orderBy("epoch")
    so_far = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = epochs.withColumn("gain_", so_far.isNull() | (F.col(metric) > so_far))
    numbered = gain.withColumn("i_", F.row_number().over(order))
    last = F.max(F.when(F.col("gain_"), F.col("i_"))).over(order)
    ran = numbered.withColumn("idle_", F.col("i_") - last).withColumn("over_", F.coalesce(F.max((F.col("idle_") >= patience).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    alive = F.col("over_") == 0
    whole = Window.partitionBy(F.lit(1))
    top = F.max(F.when(alive, F.struct(F.col(metric).alias("m"), (-F.col("i_")).alias("i")))).over(whole)
    end = F.max(F.when(alive, F.col("i_"))).over(whole)
    out = ran.withColumns({"b_": -top["i"], "l_": end})
    kept = alive & ((F.col("i_") == F.col("b_")) | (F.col("i_") > F.col("l_") - (keep - 1)))
    return out.select("epoch", metric, (F.col("i_") == F.col("b_")).alias("best"), (~alive).alias("stopped"), kept.alias("kept"))


def predictions(scored: DataFrame, mapping: DataFrame, logits: str = "logits") -> DataFrame:
    """Prediction rows from (text, label_id, logits): actual and predicted label and id, confidence, correct.

    Ids without a label read ``unknown_<id>``.
    """
    from pointprep.functions.text import argmax, softmax_max

    named = lambda i, m: F.coalesce(m, F.concat(F.lit("unknown_"), i.cast("string")))
    p = scored.select("text", F.col("label_id").alias("actual_id"), argmax(F.col(logits)).alias("predicted_id"), softmax_max(F.col(logits)).alias("confidence"))
    a = mapping.select(F.col("label_id").alias("actual_id"), F.col("label").alias("a_"))
    q = mapping.select(F.col("label_id").alias("predicted_id"), F.col("label").alias("p_"))
    return p.join(a, "actual_id", "left").join(q, "predicted_id", "left").select(
        "text", named(F.col("actual_id"), F.col("a_")).alias("actual_label"), "actual_id", named(F.col("predicted_id"), F.col("p_")).alias("predicted_label"), "predicted_id", "confidence", (F.col("actual_id") == F.col("predicted_id")).alias("correct")
    )
