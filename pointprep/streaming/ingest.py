"""Profiles that arrive over time: the scan as a stream, matched by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pointprep.sources.profiles import parse_files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def profile_stream(spark: SparkSession, directory: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.{yml,yaml}").option("recursiveFileLookup", True).load(directory)
    return parse_files(files)


def ingest(spark: SparkSession, directory: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parsed files that have come since the last call, appended to ``out`` as Parquet."""
    return profile_stream(spark, directory).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
