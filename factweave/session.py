"""Session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; partitions are Spark's to coalesce and skewed joins its to split."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
