"""Signals that live for three half-lives of event time, in a stream and in a batch.

A signal (``signal_id``, ``time``, ``strength``) is active from its first row until it has had
no row for ``life_days``; each span of activity is one row: signal_id, started, expired, rows,
and the strength of its last row (the greater of equal times). Rows without an id or time take
no part. The stream emits a span when the watermark passes its end, and drops rows later
than that; rows that come late but in time give the same spans as a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LIFE_DAYS = 3 * 14
SPAN = "signal_id string, started timestamp, expired timestamp, n long, strength double"
DAY_US = 86_400_000_000


def _clean(signals: DataFrame) -> DataFrame:
    return signals.where("signal_id IS NOT NULL AND time IS NOT NULL").select(F.col("signal_id").cast("string").alias("signal_id"), F.col("time").cast("timestamp").alias("time"), F.col("strength").cast("double").alias("strength"))


def spans(signals: DataFrame, life_days: int = LIFE_DAYS) -> DataFrame:
    """The batch twin: all spans, those not yet expired included."""
    rows = _clean(signals).withColumn("us", F.unix_micros("time"))
    order = Window.partitionBy("signal_id").orderBy("us", F.col("strength").asc_nulls_first())
    fresh = F.coalesce(F.col("us") - F.lag("us").over(order) >= life_days * DAY_US, F.lit(True))
    numbered = rows.withColumn("span", F.sum(fresh.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("us", "strength"))
    found = numbered.groupBy("signal_id", "span").agg(F.min("us").alias("first"), last.alias("last"), F.count("*").alias("n"))
    return found.select("signal_id", F.timestamp_micros("first").alias("started"), F.timestamp_micros(F.col("last.us") + life_days * DAY_US).alias("expired"), "n", F.col("last.strength").alias("strength"))


class Spans(StatefulProcessor):
    """Open spans of a signal as (first, last, rows, strength) in microseconds; rows join or
    bridge them, and a timer at each span's end emits it."""

    def __init__(self, life_days: int) -> None:
        self.life = life_days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, strength double")

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            us = part["time"].astype("datetime64[us]").astype("int64")
            held += [(t, t, 1, None if pd.isna(s) else float(s)) for t, s in zip(us.tolist(), part["strength"], strict=True)]
        merged: list[tuple] = []
        for first, last, n, strength in sorted(held, key=lambda x: x[:2]):
            if merged and first - merged[-1][1] < self.life:
                a, b, m, s = merged[-1]
                newest = max((b, s is not None, s or 0.0, s), (last, strength is not None, strength or 0.0, strength))
                merged[-1] = (a, newest[0], m + n, newest[3])
            else:
                merged.append((first, last, n, strength))
        self.open.put(merged)
        for _, last, _, _ in merged:
            self.handle.registerTimer((last + self.life + 999) // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = self._held()
        done = [x for x in held if x[1] + self.life <= now]
        kept = [x for x in held if x[1] + self.life > now]
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        if done:
            times = [pd.to_datetime([x[0] for x in done], unit="us"), pd.to_datetime([x[1] + self.life for x in done], unit="us")]
            yield pd.DataFrame({"signal_id": key[0], "started": times[0], "expired": times[1], "n": [x[2] for x in done], "strength": [x[3] for x in done]})

    def close(self) -> None:
        pass


def expiring(signals: DataFrame, life_days: int = LIFE_DAYS, late: str = "1 day") -> DataFrame:
    """The stream: spans as they expire. State is kept in RocksDB, which the session must name
    (``spark.sql.streaming.stateStore.providerClass``)."""
    grouped = _clean(signals).withWatermark("time", late).groupBy("signal_id")
    return grouped.transformWithStateInPandas(Spans(life_days), SPAN, "Append", "EventTime")
