"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lexitally", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on; give cluster settings as keyword=value pairs with __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A partition of texts grows many times over when its terms are counted,
        # so small ones are not merged as eagerly as rows that stay small.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update({key.replace("__", "."): value for key, value in settings.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
