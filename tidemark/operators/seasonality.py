"""Annual, monthly and decennial seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, correlation, divided, simple_return
from . import detrend


def best_months(months: DataFrame, count: int = 3) -> DataFrame:
    """Of ``monthly``: each series' ``count`` best and worst months with their places, ties
    to the earlier month; a month may be among both."""
    of = Window.partitionBy("series_id")
    best = F.row_number().over(of.orderBy(F.desc("avg_return"), "month"))
    worst = F.row_number().over(of.orderBy("avg_return", "month"))
    placed = months.where(F.col("avg_return").isNotNull()).withColumns({"best": best, "worst": worst})
    return placed.where((F.col("best") <= count) | (F.col("worst") <= count)).select("series_id", "month", "avg_return", "best", "worst")


def annual_cycle(bars: DataFrame, least_years: int = 3) -> DataFrame:
    """Per day of the year: mean position within the year (trend off, range to 0..1),
    spread and confidence (1 - spread / mean, within 0..1)."""
    dated = bars.withColumn("year", F.year("time"))
    flat = detrend.linear(dated.withColumn("t", F.dayofyear("time").cast("long")), "close", ["series_id", "year"])
    year = Window.partitionBy("series_id", "year")
    low, high = F.min("detrended").over(year), F.max("detrended").over(year)
    scaled = flat.withColumn("x", divided(F.col("detrended") - low, high - low))
    days = scaled.groupBy("series_id", F.col("t").alias("day")).agg(F.avg("x").alias("value"), F.stddev_pop("x").alias("spread"), F.count_distinct("year").alias("years"))
    confidence = clip(1 - divided(F.col("spread"), F.col("value")), 0.0, 1.0)
    return days.where(F.col("years") >= least_years).withColumn("confidence", confidence)


def daily_profile(bars: DataFrame) -> DataFrame:
    """Per day of the year: mean and spread of returns, win rate, sample, rank of the mean."""
    moves = bars.withColumn("r", simple_return(F.col("close"), by_time())).where("r IS NOT NULL")
    days = moves.groupBy("series_id", F.dayofyear("time").cast("long").alias("day")).agg(
        F.avg("r").alias("avg_return"), F.stddev_pop("r").alias("std_dev"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.count("*").alias("sample_size")
    )
    return days.withColumn("percentile", F.percent_rank().over(Window.partitionBy("series_id").orderBy("avg_return")))


def monthly(bars: DataFrame) -> DataFrame:
    """Mean monthly returns, and whether a month is the best or the worst."""
    months = bars.groupBy("series_id", F.year("time").alias("year"), F.month("time").cast("long").alias("month")).agg(F.min_by("close", "time").alias("first"), F.max_by("close", "time").alias("last"))
    means = months.groupBy("series_id", "month").agg(F.avg(divided(F.col("last"), F.col("first")) - 1).alias("avg_return"), F.count("*").alias("years"))
    w = Window.partitionBy("series_id")
    best = F.max(F.struct("avg_return", (-F.col("month")).alias("m"))).over(w)["m"] == -F.col("month")
    worst = F.min(F.struct("avg_return", "month")).over(w)["month"] == F.col("month")
    return means.withColumns({"is_best": best, "is_worst": worst})


def annual_returns(bars: DataFrame) -> DataFrame:
    """(last - first) / first per calendar year; years of one bar or a first close that is
    not positive are left out."""
    years = bars.groupBy("series_id", F.year("time").cast("long").alias("year")).agg(F.min_by("close", "time").alias("first"), F.max_by("close", "time").alias("last"), F.count("*").alias("n"))
    return years.where("n >= 2 AND first > 0").select("series_id", "year", ((F.col("last") - F.col("first")) / F.col("first")).alias("ret"))


def digits(returns: DataFrame) -> DataFrame:
    """All ten last digits of years per series: mean, spread, win rate, count, score (the
    mean within the range of all annual returns) and confidence; fewer than two years: 0,
    score 0.5."""
    series = returns.groupBy("series_id").agg(F.min("ret").alias("low"), F.max("ret").alias("high"))
    every = series.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("digit"))
    stats = returns.groupBy("series_id", F.pmod("year", F.lit(10)).alias("digit")).agg(
        F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.avg((F.col("ret") > 0).cast("double")).alias("w")
    )
    wide = every.join(stats, ["series_id", "digit"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    enough = F.col("n") >= 2

    def unless(x, other: float):
        return F.when(enough, x).otherwise(F.lit(other))

    score = F.coalesce(divided(F.col("m") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    return wide.select(
        "series_id", "digit", "n", unless(F.col("m"), 0.0).alias("avg_return"), unless(F.col("s"), 0.0).alias("std_dev"), unless(F.col("w"), 0.0).alias("win_rate"),
        unless(clip(score, 0.0, 1.0), 0.5).alias("score"), unless(F.least(F.lit(1.0), F.col("n") / 5), 0.0).alias("confidence"),
    )


def similar_digits(stats: DataFrame) -> DataFrame:
    """1 - |difference of scores| of each pair of digits of a series (ten by ten)."""
    other = stats.select("series_id", F.col("digit").alias("other"), F.col("score").alias("other_score"), F.col("n").alias("other_n"))
    return stats.select("series_id", "digit", "score").join(other, "series_id").withColumn("similarity", 1 - F.abs(F.col("score") - F.col("other_score")))


def decennial(bars: DataFrame, current_year: int, least_years: int = 30, kind: str = "stock") -> DataFrame:
    """One row per series: the current digit's statistics, trend, most similar digit with
    data, completeness, and status. Crypto is not supported, as its history is short."""
    returns = annual_returns(bars)
    years = bars.groupBy("series_id").agg(F.count_distinct(F.year("time")).alias("years"))
    stats = digits(returns)
    now = current_year % 10
    pairs = similar_digits(stats).where((F.col("digit") == now) & (F.col("other") != now) & (F.col("other_n") >= 2))
    best = pairs.groupBy("series_id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("b"))
    complete = stats.groupBy("series_id").agg((F.count_if(F.col("n") >= 2) / 10).alias("completeness"))
    current = stats.where(F.col("digit") == now)
    joined = years.join(current, "series_id", "left").join(best, "series_id", "left").join(complete, "series_id", "left")
    trend = F.when(F.col("confidence") > 0.3, F.when(F.col("avg_return") > 0.05, "bullish").when(F.col("avg_return") < -0.05, "bearish").otherwise("neutral"))
    status = F.lit("crypto_unsupported") if kind.lower() == "crypto" else F.when(F.col("years") < least_years, "insufficient_data").otherwise("valid")
    return joined.select(
        "series_id", "years", F.lit(now).cast("long").alias("digit"), "avg_return", "win_rate", "score", "confidence", trend.alias("trend"),
        (-F.col("b.o")).alias("similar_digit"), F.col("b.similarity").alias("similarity"), "completeness", status.alias("status"),
    )


def forecast(stats: DataFrame, digit: int, top: int = 3) -> DataFrame:
    """Mean of the ``top`` digits whose mean return is nearest that of ``digit``, itself
    included, among digits of confidence above 0.3."""
    own = stats.where(F.col("digit") == digit).select("series_id", F.col("avg_return").alias("own"))
    near = stats.where("confidence > 0.3").join(own, "series_id").withColumn("gap", F.abs(F.col("avg_return") - F.col("own")))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("gap", "digit"))).where(F.col("n") <= top)
    return ranked.groupBy("series_id").agg(F.avg("avg_return").alias("forecast"), F.count("*").alias("patterns"))


def day_pattern(bars: DataFrame) -> DataFrame:
    """Mean position within the year by (digit, day of the year)."""
    dated = bars.withColumn("year", F.year("time"))
    year = Window.partitionBy("series_id", "year")
    low, high = F.min("close").over(year), F.max("close").over(year)
    scaled = dated.withColumn("x", divided(F.col("close") - low, high - low))
    return scaled.groupBy("series_id", F.pmod("year", F.lit(10)).cast("long").alias("digit"), F.dayofyear("time").cast("long").alias("day")).agg(F.avg("x").alias("value"), F.count("*").alias("n"))


def pattern_correlation(bars: DataFrame, year: int) -> DataFrame:
    """Correlation of a year's closes with its digit's pattern from all other years."""
    past = day_pattern(bars.where(F.year("time") != year)).where(F.col("digit") == year % 10)
    current = bars.where(F.year("time") == year).select("series_id", F.dayofyear("time").cast("long").alias("day"), "close")
    return current.join(past, ["series_id", "day"]).groupBy("series_id").agg(correlation(F.col("close"), F.col("value")).alias("r"), F.count("*").alias("days"))


def extremes(profile: DataFrame, value: str = "avg_return") -> DataFrame:
    """Per series of a daily profile: the day of its peak and of its trough (the earlier of
    equal ones), and the distance between the two."""
    high, low = F.max(F.struct(value, (-F.col("day")).alias("d"))), F.min(F.struct(value, "day"))
    found = profile.where(F.col(value).isNotNull()).groupBy("series_id").agg(high.alias("h"), low.alias("l"))
    return found.select("series_id", (-F.col("h.d")).alias("peak_day"), F.col("l.day").alias("trough_day"), (F.col(f"h.{value}") - F.col(f"l.{value}")).alias("amplitude"))


def current_signal(cycle: DataFrame, dates: DataFrame, ahead: int = 7) -> DataFrame:
    """Per row of ``dates`` (series_id, time): BUY, SELL or NEUTRAL as the annual cycle's
    mean of the next ``ahead`` days is above, below or at (or lacks) its value of that day;
    the gap weighed by confidence as strength; expiry. After day 365 follows day 1, and day
    366 counts as day 1."""
    days = dates.select("series_id", "time", F.explode(F.sequence(F.lit(0), F.lit(ahead))).alias("step"))
    placed = days.withColumn("day", (F.pmod(F.dayofyear("time") - 1 + F.col("step"), F.lit(365)) + 1).cast("long"))
    joined = placed.join(cycle.select("series_id", "day", "value", "confidence"), ["series_id", "day"], "left")
    now, later = F.max(F.when(F.col("step") == 0, F.col("value"))), F.avg(F.when(F.col("step") > 0, F.col("value")))
    found = joined.groupBy("series_id", "time").agg((later - now).alias("gap"), F.avg("confidence").alias("confidence"))
    strength = clip(F.coalesce(F.abs("gap") * F.col("confidence"), F.lit(0.0)), 0.0, 1.0)
    kind = F.when(F.col("gap") > 0, "BUY").when(F.col("gap") < 0, "SELL").otherwise("NEUTRAL")
    return found.select(
        F.concat_ws("_", F.lit("sig"), "series_id", F.date_format("time", "yyyyMMdd")).alias("id"), "series_id", "time", kind.alias("signal_type"),
        strength.alias("strength"), strength.alias("initial_strength"), F.date_add("time", ahead).alias("expiry_date"), F.lit("annual_cycle").alias("source"),
    )
