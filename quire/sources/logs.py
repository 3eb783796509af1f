"""Stage timings in log text, as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE = r"^\s*(?:\[?timing\]?[: ]+)?([A-Za-z][\w\- ]*?)\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|s|us)\b"


def stage_times(spark: SparkSession, path: str) -> DataFrame:
    """file, stage, ms from lines like ``[timing] prefill: 460.0 ms``; other lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(STAGE))
    part = lambda k: F.regexp_extract("value", STAGE, k)
    scale = F.when(part(3) == "s", 1000.0).when(part(3) == "us", 0.001).otherwise(1.0)
    return lines.select("file", F.lower(F.regexp_replace(part(1), r"[\s\-]+", "_")).alias("stage"), (part(2).cast("double") * scale).alias("ms"))
