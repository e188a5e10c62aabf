"""Device profiles in YAML: recursive scan, isolated errors, points unnested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointprep.functions.text import strip_suffix

PARSED = "path string, profile_name string, error string, points array<struct<name:string,value_type:string>>"


def parsed(content: bytes) -> tuple[str | None, str | None, list[dict]]:
    """(profile name, error, points); a file that fails in any place has no points.

    ``unknown`` stands for missing keys only: an explicit null stays null.
    """
    import yaml

    try:
        doc = yaml.safe_load(content)
        name = doc.get("name", "unknown")
        points = []
        for item in doc.get("deviceResources", []):
            raw = item.get("name", "")
            if not raw:
                continue
            if not isinstance(raw, str):
                raise TypeError(f"name {raw!r} is no string")
            points.append({"name": raw, "value_type": item.get("properties", {}).get("valueType", "unknown")})
        return name, None, points
    except Exception as e:  # any fault of one file is that file's alone
        return None, f"{type(e).__name__}: {e}", []


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (path, content) to ``PARSED``. YAML is the one thing here that needs Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *parsed(bytes(c))) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "profile_name", "error", "points"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each ``.yml`` and ``.yaml`` file below ``directory``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml}").option("recursiveFileLookup", True).load(directory)
    return parse_files(files)


def points(files: DataFrame, directory: str) -> DataFrame:
    """(raw_name, clean_name, profile_name, source_file, value_type, file_rank, path, pos): .yml files before .yaml, then by path and place."""
    root = "file:" + directory.rstrip("/") + "/" if directory.startswith("/") else directory.rstrip("/") + "/"
    each = files.where("error is null").select("path", "profile_name", F.posexplode("points").alias("pos", "p"))
    relative = F.when(F.startswith("path", F.lit(root)), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path"))
    return each.select(F.col("p.name").alias("raw_name"), strip_suffix(F.col("p.name")).alias("clean_name"), "profile_name", relative.alias("source_file"), F.col("p.value_type").alias("value_type"), F.endswith("path", F.lit(".yaml")).cast("int").alias("file_rank"), "path", "pos")


def errors(files: DataFrame) -> DataFrame:
    return files.where("error is not null").select("path", "error")
