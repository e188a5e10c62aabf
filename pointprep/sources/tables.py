"""CSV, JSONL and JSON documents: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointprep.functions.text import na_to_null

TRAINING = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("label_id", T.IntegerType())])
MAPPING = T.StructType([T.StructField("label2id", T.MapType(T.StringType(), T.IntegerType())), T.StructField("id2label", T.MapType(T.StringType(), T.StringType())), T.StructField("num_labels", T.IntegerType())])
SUMMARY = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("total_samples", "num_classes", "train_samples", "validation_samples", "test_samples")]
    + [T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())), T.StructField("text_length_stats", T.StructType([T.StructField("min", T.IntegerType()), T.StructField("max", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("median", T.DoubleType())]))]
)
EXTRACT = ["text", "target", "confidence", "raw_name", "profile", "source_file", "value_type"]


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("text", "target"), na: bool = True) -> DataFrame:
    """String columns of a CSV with a header; missing-value tokens become null if ``na``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"')
    return df.select(*[na_to_null(F.col(c)).alias(c) for c in columns]) if na else df


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Training records. Blank lines are skipped; if ``strict`` they fail, as do malformed ones."""
    if not strict:
        return spark.read.schema(TRAINING).json(path, mode="PERMISSIVE")
    line = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line in JSONL")).cast("string")).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(line, TRAINING, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_mapping(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """(label, label_id) of a label mapping document. A map schema: labels may differ in case alone.

    Without a label2id that is an error if the mapping is ``required``, else there is no mapping.
    """
    doc = spark.read.schema(MAPPING).json(path, multiLine=True)
    found = doc.select("label2id").first()
    if not found or found[0] is None:
        if required:
            raise ValueError("the mapping has no label2id")
        return None
    return doc.select(F.explode("label2id").alias("label", "label_id"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``one_file`` is for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select("text", "label", "label_id").write.mode("overwrite").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row frame (mapping, summary, results) as one JSON document."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_extract(df: DataFrame, path: str) -> None:
    write_csv(df.select(*EXTRACT), path)
