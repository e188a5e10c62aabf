"""Label vocabularies, lookup tables and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointprep.functions.text import camel_split, normalize

#: Ordered keyword rules (keywords, [(location, label)], default label).
RULES = [
    (["temp", "temperature"], [("zone", "zoneTemp"), ("discharge", "dischargeTemp"), ("supply", "dischargeTemp"), ("return", "returnTemp"), ("outside", "outsideTemp"), ("outdoor", "outsideTemp"), ("mixed", "mixedTemp")], None),
    (["humidity", "rh"], [("zone", "zoneHumidity"), ("discharge", "dischargeHumidity"), ("return", "returnHumidity"), ("outside", "outsideHumidity")], None),
    (["fan"], [("discharge", "dischargeFanStatus"), ("supply", "dischargeFanStatus"), ("return", "returnFanStatus"), ("exhaust", "exhaustFanStatus")], None),
    (["damper"], [("discharge", "dischargeDamper"), ("return", "returnDamper"), ("outside", "outsideDamper"), ("exhaust", "exhaustDamper")], None),
    (["current"], [("phase a", "currentPhaseA"), ("phase b", "currentPhaseB"), ("phase c", "currentPhaseC"), ("average", "current")], "current"),
    (["energy"], [("reactive", "energyReactive"), ("apparent", "energyApparent")], "energy"),
]

#: Keyword of a word and the label parts that it speaks for; repeated parts count again.
KEYWORDS = {
    "temp": ["Temp", "Temperature"], "temperature": ["Temp", "Temperature"], "energy": ["energy"], "power": ["power"], "reactive": ["Reactive"], "apparent": ["Apparent"],
    "current": ["current", "Current"], "phase a": ["PhaseA"], "phase b": ["PhaseB"], "phase c": ["PhaseC"], "flow": ["Flow"], "pressure": ["Pressure"], "press": ["Pressure"],
    "humidity": ["Humidity"], "rh": ["Humidity"], "damper": ["Damper"], "fan": ["Fan"], "valve": ["Valve"], "status": ["Status"], "sts": ["Status"], "setpoint": ["Sp"], "sp": ["Sp"],
}


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(label, label_id): distinct values that are not null, numbered from 0 by code point.

    Labels are numbered among those with the same first characters; the only window over everything has one row for each such beginning.
    """
    labels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct().withColumn("start_", F.substring(F.col("label").cast("string"), 1, 3))
    starts = labels.groupBy("start_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("start_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("start_").orderBy("label")) - 1
    return labels.withColumn("nth_", nth).join(starts.withColumn("before_", before), "start_").select("label", (F.col("before_") + F.col("nth_")).cast("int").alias("label_id"))


def lookup(vocab: DataFrame) -> DataFrame:
    """(key, label): each label under its normalised and its camel-split form; of colliding labels the last wins."""
    variants = F.array(F.struct(normalize(F.col("label")).alias("key"), (F.col("label_id") * 2).alias("ord")), F.struct(camel_split(F.col("label")).alias("key"), (F.col("label_id") * 2 + 1).alias("ord")))
    return vocab.select("label", F.inline(variants)).groupBy("key").agg(F.max_by("label", "ord").alias("label"))


def mapping_row(vocab: DataFrame) -> DataFrame:
    """One row: label2id, id2label, num_labels."""
    pairs = F.sort_array(F.collect_list(F.struct("label_id", "label")))
    return vocab.agg(pairs.alias("p"), F.count("*").cast("int").alias("num_labels")).select(
        F.map_from_arrays(F.col("p.label"), F.col("p.label_id")).alias("label2id"), F.map_from_arrays(F.transform("p.label_id", lambda i: i.cast("string")), F.col("p.label")).alias("id2label"), "num_labels"
    )


def rules_in(labels: set[str], rules=RULES) -> list:
    """``rules`` without targets that are no labels: the next location is then tried."""
    return [(k, [(loc, lab) for loc, lab in at if lab in labels], d if d in labels else None) for k, at, d in rules]
