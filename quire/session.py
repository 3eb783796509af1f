"""Session builder with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """Adaptive execution, UTC, ANSI and Arrow on; a master and sizes are left to the caller's configuration."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
