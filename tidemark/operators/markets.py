"""Days of markets in different time zones.

A calendar has a row per series: ``series_id``, ``zone``, ``closes`` (minutes after local
midnight at which its day ends, 1440 for midnight itself) and ``weekends`` (whether it trades
on them). Times are UTC. What comes after a day's close belongs to the next day; where there
is no trade on weekends, to Monday. Summer time follows from the zone. Series that the
calendar doesn't have, or bars without a time, are left out; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_day(time: Column, zone: Column, closes: Column, weekends: Column) -> Column:
    """The day whose close is the first after the instant ``time``."""
    local = F.convert_timezone(F.lit("UTC"), zone, time.cast("timestamp_ntz"))
    day = (local + F.make_dt_interval(mins=F.lit(1440) - closes)).cast("date")
    ahead = F.when(weekends, 0).when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0)
    return F.date_add(day, ahead)


def session_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars (series_id, time of their start, open, high, low, close, volume) put together by
    trading day: series_id, day, open, high, low, close, volume, bars. A bar that begins
    before a close and ends after it counts to the day that closes."""
    known = bars.where("time IS NOT NULL").join(calendar, "series_id")
    day = trading_day(F.col("time"), F.col("zone"), F.col("closes"), F.col("weekends")).alias("day")
    return known.groupBy("series_id", day).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"),
    )


def every_day(sessions: DataFrame) -> DataFrame:
    """series_id, day, close, carried: a row for every calendar day between a series' first
    and last; days without a session carry the last close."""
    after = F.lead("day").over(Window.partitionBy("series_id").orderBy("day"))
    held = sessions.select("series_id", "day", "close", F.coalesce(F.date_sub(after, 1), F.col("day")).alias("until"))
    spread = held.select("series_id", "day", "close", F.explode(F.sequence("day", "until")).alias("on"))
    return spread.select("series_id", F.col("on").alias("day"), "close", (F.col("on") > F.col("day")).alias("carried"))


def beside(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """Each close of ``daily`` (other_id, day, other_close: a series of every day) beside what
    every series of ``sessions`` last closed at on that day: series_id, other_id, day, close,
    other_close, carried. One join by day; no row where one of the two has no day yet."""
    return every_day(sessions).join(daily.select("other_id", "day", "other_close"), "day").select("series_id", "other_id", "day", "close", "other_close", "carried")
