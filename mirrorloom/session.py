"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "mirrorloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting; more settings by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
