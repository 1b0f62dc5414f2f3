"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting, Arrow. On a cluster leave ``master``
    unset and size ``spark.sql.shuffle.partitions`` by the input."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
