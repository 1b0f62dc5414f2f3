"""Continuous aggregates, alerts and stateful views.

Each takes a streaming DataFrame and also runs on a batch one, with the same result once
all data are in; late rows beyond the watermark are dropped by the stream only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def _marked(ticks: DataFrame, time: str, late: str) -> DataFrame:
    """``time`` as a timestamp, with a watermark if the rows are a stream."""
    timed = ticks.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late) if ticks.isStreaming else timed


def continuous(ticks: DataFrame, series: str, time: str, value: str, bucket: str = "1 day", late: str = "30 days") -> DataFrame:
    """Mean, spread and count by series and bucket; buckets close ``late`` after their end."""
    marked = _marked(ticks, time, late)
    grouped = marked.groupBy(F.col(series).alias("series_id"), F.window(time, bucket).alias("w"))
    return grouped.agg(F.avg(value).alias("avg_value"), F.stddev_samp(value).alias("std_value"), F.count("*").alias("n")).select("series_id", F.col("w.start").alias("bucket"), "avg_value", "std_value", "n")


def sliding(ticks: DataFrame, series: str, time: str, value: str, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    marked = _marked(ticks, time, late)
    grouped = marked.groupBy(F.col(series).alias("series_id"), F.window(time, width, step).alias("w"))
    return grouped.agg(F.avg(value).alias("avg_value"), F.count("*").alias("n")).select("series_id", F.col("w.start").alias("bucket"), "avg_value", "n")


def sessions(ticks: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    marked = _marked(ticks, time, late)
    grouped = marked.groupBy(F.col(key).alias("key"), F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def alerts(ticks: DataFrame, series: str, time: str, most: int = 3, late: str = "1 day") -> DataFrame:
    """Days with more than ``most`` rows of a series."""
    marked = _marked(ticks, time, late)
    days = marked.groupBy(F.col(series).alias("series_id"), F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return days.where(F.col("n") > most).select("series_id", F.col("w.start").alias("day"), "n")


LAST = "series_id string, last_time timestamp, n long"


def freshness(ticks: DataFrame, series: str, time: str, timeout_ms: int = 4 * 3600 * 1000) -> DataFrame:
    """Last time and count of each series, updated as rows come; a series without rows for
    ``timeout_ms`` is forgotten. State is two numbers per series."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (0, 0)
        for part in parts:
            last, n = max(last, int(part["at"].max().value)), n + len(part)
        state.update((last, n))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"series_id": [key[0]], "last_time": [pd.Timestamp(last)], "n": [n]})

    rows = ticks.select(F.col(series).alias("series_id"), F.col(time).cast("timestamp").alias("at"))
    return rows.groupBy("series_id").applyInPandasWithState(update, LAST, "last long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def publish(view: DataFrame, name: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Write a view to a memory table; ``once`` takes what is there and stops."""
    writer = view.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
