"""Structured Streaming forms: rolling usage, rate limits, and profiles of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, format: str = "parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(format).load(folder)


def windowed_usage(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """window_start, by, n, mean: tumbling windows; events later than ``late`` are left out, which bounds the state."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = stamped.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "mean")


def over_limit(requests: DataFrame, key: str, limit: int = 100, width: str = "300 seconds", slide: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """window_start, key, n: keys with over ``limit`` requests in a sliding window."""
    stamped = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, width)
    out = stamped.groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return out.select(F.col("window.start").alias("window_start"), key, "n")


def profile_batches(stream: DataFrame, profile: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Profile each micro-batch and append the result, marked by its number; a batch that is run again overwrites its own part."""

    def one(batch: DataFrame, number: int) -> None:
        profile(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
