"""Trading days across time zones, against the standard library's zones."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import markets

CALENDAR = [("ny", "America/New_York", 960, False), ("tokyo", "Asia/Tokyo", 900, False), ("coin", "UTC", 1440, True), ("unused", "UTC", 60, True)]
BARS = "series_id string, time timestamp_ntz, open double, high double, low double, close double, volume long"
UTC = dt.timezone.utc


def plain_day(time, zone, closes, weekends):
    local = time.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    day = local.date()
    if local >= dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=closes):
        day += dt.timedelta(days=1)
    while not weekends and day.weekday() >= 5:
        day += dt.timedelta(days=1)
    return day


def calendar(spark):
    return spark.createDataFrame(CALENDAR, "series_id string, zone string, closes int, weekends boolean")


def test_a_year_of_hours_by_brute_force(spark):
    rng, rows = np.random.default_rng(1), []
    for name, *_ in CALENDAR[:3]:
        for h in range(24 * 366):
            o, c = rng.random(2).tolist()
            rows.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), o, o + c, -o, c, h))
    zones = {name: rest for name, *rest in CALENDAR}
    want = {}
    for name, time, o, h, low, c, v in rows:
        key = name, plain_day(time, *zones[name])
        old = want.get(key)
        want[key] = (o, h, low, c, v, 1) if old is None else (old[0], max(old[1], h), min(old[2], low), c, old[4] + v, old[5] + 1)
    frame = spark.createDataFrame([*rows, ("absent", dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1), ("ny", None, 1.0, 1.0, 1.0, 1.0, 1)], BARS)
    got = {(r["series_id"], r["day"]): tuple(r)[2:] for r in markets.session_bars(frame, calendar(spark)).collect()}
    assert got == want
    assert markets.session_bars(frame.limit(0), calendar(spark)).count() == 0


def test_summer_time_moves_the_close(spark):
    """New York closes at 21:00 UTC in winter and at 20:00 in summer."""
    hours = [("ny", dt.datetime(2024, m, d, h), 0.0, 0.0, 0.0, float(h), 1) for m, d in ((3, 8), (3, 11), (11, 1), (11, 4)) for h in (19, 20)]
    got = {r["day"]: r["close"] for r in markets.session_bars(spark.createDataFrame(hours, BARS), calendar(spark)).collect()}
    assert got == {dt.date(2024, 3, 8): 20, dt.date(2024, 3, 11): 19, dt.date(2024, 3, 12): 20, dt.date(2024, 11, 1): 19, dt.date(2024, 11, 4): 20}


def test_weekends_carry_fridays_close(spark):
    days = spark.createDataFrame([("ny", dt.date(2024, 3, 7), 1.0), ("ny", dt.date(2024, 3, 8), 2.0), ("ny", dt.date(2024, 3, 11), 3.0)], "series_id string, day date, close double")
    always = spark.range(8).select(F.lit("coin").alias("other_id"), F.date_add(F.lit("2024-03-05").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").cast("double").alias("other_close"))
    got = [(r["day"].day, r["close"], r["other_close"], r["carried"]) for r in markets.beside(days, always).orderBy("day").collect()]
    assert got == [(7, 1.0, 2.0, False), (8, 2.0, 3.0, False), (9, 2.0, 4.0, True), (10, 2.0, 5.0, True), (11, 3.0, 6.0, False)]
    plan = markets.beside(days, always)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
