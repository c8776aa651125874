"""Session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "leadloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution on, skewed joins split at run time. Cluster settings (master, memory) come from outside."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
