"""Positioning reports, signals, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, decayed, divided, premium, rolling_rank, trailing


def positioning_index(reports: DataFrame, width: int = 26) -> DataFrame:
    """(x - low) / (high - low) * 100 over the last ``width`` reports; null on no range."""
    w = trailing(width)
    low, high = F.min("net").over(w), F.max("net").over(w)
    return reports.withColumn("positioning_index", divided(F.col("net") - low, high - low) * 100)


def premium_index(reports: DataFrame, width: int = 26) -> DataFrame:
    """premium in percent and its strict percentile over the last ``width`` reports."""
    priced = reports.withColumn("premium", premium(F.col("price"), F.col("nav")))
    return priced.withColumn("premium_index", rolling_rank(F.col("premium"), trailing(width), "strict") * 100)


def since_change(reports: DataFrame, instruments: DataFrame) -> DataFrame:
    """Reports from an instrument's regime change on; all of them where it has none."""
    joined = reports.join(instruments.select("series_id", "regime_change_date"), "series_id")
    return joined.where(F.col("regime_change_date").isNull() | (F.col("time") >= F.col("regime_change_date"))).drop("regime_change_date")


def extremes(rows: DataFrame, index: str, direction: int = -1, high: float = 80.0, low: float = 20.0) -> DataFrame:
    """is_extreme and signal: with ``direction`` -1 a high index is BEARISH."""
    top, bottom = ("BEARISH", "BULLISH") if direction < 0 else ("BULLISH", "BEARISH")
    signal = F.when(F.col(index) > high, top).when(F.col(index) < low, bottom).otherwise("NEUTRAL")
    return rows.withColumns({"signal": signal, "is_extreme": signal != "NEUTRAL"})


def spaced(signals: DataFrame, days: int = 21, kind: str = "signal") -> DataFrame:
    """Signals of which no earlier kept one of the same kind and series lies within
    ``days`` days: a greedy fold over the days of each (series, kind)."""
    day = F.unix_date(F.to_date("time"))
    listed = signals.groupBy("series_id", kind).agg(F.sort_array(F.collect_set(day)).alias("days"))
    empty = F.array().cast("array<int>")
    kept = F.aggregate("days", empty, lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > days), F.concat(a, F.array(v))).otherwise(a))
    chosen = listed.select("series_id", kind, F.explode(kept).alias("_day"))
    return chosen.select("series_id", kind, F.date_from_unix_date("_day").alias("time"), F.date_add(F.date_from_unix_date("_day"), days + 1).alias("next_valid"))


def weighted(indices: DataFrame, proxies: DataFrame) -> DataFrame:
    """Liquidity-weighted index: rows (series_id, value, volume, aum), fixed weights in
    ``proxies`` (series_id, weight) where liquidity is missing."""
    joined = indices.join(proxies, "series_id")
    weight = F.coalesce(F.nullif(F.col("volume") * F.col("aum"), F.lit(0.0)), F.col("weight"))
    return joined.agg(divided(F.sum(weight * F.col("value")), F.sum(weight)).alias("index"), F.count("*").alias("proxies"))


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.groupBy("series_id").agg(F.max("time").alias("time"), F.max_by("price", "time").alias("price"), F.max_by("volume", "time").alias("volume"))


def aged(signals: DataFrame, as_of: Column, half_life: int = 14) -> DataFrame:
    """Age in days, decayed strength, and whether three half-lives have passed."""
    age = F.datediff(as_of, F.col("time"))
    return signals.withColumns({"age_days": age, "strength": decayed(F.col("initial_strength"), age, F.lit(float(half_life))), "is_expired": age > 3 * half_life})


#: Which status may follow which.
LIFECYCLE = {"PENDING": ("TRIGGERED", "EXPIRED", "CANCELLED"), "TRIGGERED": ("EXECUTED", "EXPIRED", "CANCELLED")}


def moved(signals: DataFrame, changes: DataFrame) -> DataFrame:
    """``signals`` (id, status) with allowed ``changes`` (id, to) made; ``error`` on others."""
    joined = signals.join(changes, "id", "left")
    allowed = F.lit(False)
    for before, after in LIFECYCLE.items():
        allowed = allowed | ((F.col("status") == before) & F.col("to").isin(*after))
    status = F.when(allowed, F.col("to")).otherwise(F.col("status"))
    return joined.withColumn("error", F.when(F.col("to").isNotNull() & ~allowed, F.concat_ws(" to ", "status", "to"))).withColumn("status", status).drop("to")


def agreed(directions: list[DataFrame]) -> DataFrame:
    """Series on which all frames (series_id, direction) point the same way."""
    every = directions[0].select("series_id", "direction")
    for more in directions[1:]:
        every = every.unionByName(more.select("series_id", "direction"))
    votes = every.groupBy("series_id").agg(F.count("*").alias("votes"), F.min("direction").alias("low"), F.max("direction").alias("high"))
    same = (F.col("low") == F.col("high")) & (F.col("votes") == len(directions)) & (F.col("low") != 0)
    return votes.select("series_id", "votes", F.when(same, F.col("low")).otherwise(F.lit(0)).cast("long").alias("direction"))


def position_size(trades: DataFrame, per_trade: float = 0.02, max_drawdown: float = 0.20, by_strength: bool = False) -> DataFrame:
    """size = balance * per_trade / |entry - stop|; none, with a reason, where drawdown is
    too deep or entry equals stop. potential_loss, potential_gain and their ratio."""
    risk = F.col("balance") * per_trade * (F.col("strength") if by_strength else F.lit(1.0))
    distance = F.abs(F.col("entry") - F.col("stop"))
    reason = F.when(F.col("drawdown") > max_drawdown, "drawdown limit").when(distance == 0, "RM002: entry equals stop")
    sized = trades.withColumns({"reason": reason, "size": F.when(reason.isNull(), divided(risk, distance)).otherwise(F.lit(0.0))})
    loss, gain = F.col("size") * distance, F.col("size") * F.abs(F.col("target") - F.col("entry"))
    return sized.withColumns({"potential_loss": loss, "potential_gain": gain, "risk_reward": divided(gain, loss)})


def levels(trades: DataFrame, stop: float = 0.05, take: float = 0.10) -> DataFrame:
    """Stop and target a fixed share away from entry, by side (1 long, -1 short)."""
    return trades.withColumns({"stop": F.col("entry") * (1 - F.col("side") * stop), "target": F.col("entry") * (1 + F.col("side") * take)})


def kelly(win_rate: Column, payoff: Column) -> Column:
    return F.greatest(F.lit(0.0), win_rate - divided(1 - win_rate, payoff))


def activity_alert(signals: DataFrame, most: int = 3) -> DataFrame:
    """Days with more than ``most`` signals of a series."""
    days = signals.groupBy("series_id", F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    return days.where(F.col("n") > most)


def stale(bars: DataFrame, as_of: Column, hours: float = 4.0) -> DataFrame:
    """Age of the last bar of each series and whether it exceeds ``hours``."""
    last = bars.groupBy("series_id").agg(F.max("time").alias("last_time"))
    age = (as_of.cast("timestamp").cast("long") - F.col("last_time").cast("timestamp").cast("long")) / 3600
    return last.withColumn("age_hours", age).withColumn("is_stale", F.col("age_hours") > hours)


def retained(bars: DataFrame, as_of: Column, days: int = 30, keep: str = "1d") -> DataFrame:
    """Rows not older than ``days``, and all of timeframe ``keep``."""
    return bars.where((F.col("timeframe") == keep) | (F.datediff(as_of, F.col("time")) <= days))


def lagged_signals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("previous", F.lag("signal").over(by_time(order="time")))


def proxied(instruments: DataFrame) -> DataFrame:
    """One row per proxy of an instrument: map ``proxy_weights`` exploded."""
    return instruments.select("series_id", F.explode("proxy_weights").alias("proxy", "weight"))


def decayed_best(signals: DataFrame, top: int = 5) -> DataFrame:
    order = Window.partitionBy("series_id").orderBy(F.desc("strength"), "time")
    return signals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def recent(instruments: DataFrame, signals: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Signals (series_id, time, direction, strength) of the last ``days`` days, with the
    symbol of their instrument (series_id, symbol); the filter precedes the join."""
    fresh = signals.where(F.col("time") >= F.date_sub(now, days)).select("series_id", "direction", "strength")
    return instruments.select("series_id", "symbol").join(fresh, "series_id").select("symbol", "direction", "strength")


def with_status(signals: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` signals (id, time, status) of these statuses, ties by id."""
    return signals.where(F.col("status").isin(statuses)).orderBy(F.desc("time"), "id").limit(limit)


def navigated(signals: DataFrame, lineage: DataFrame, tests: DataFrame) -> DataFrame:
    """Every signal (signal_id) with its lineage and its backtest, null where it has none."""
    return signals.join(lineage, "signal_id", "left").join(tests, "signal_id", "left")


def combined(directions: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted mean direction of named frames (series_id, direction, strength) over those
    that a series is in, and its sign; a frame without a weight counts 1."""
    votes = None
    for name, frame in directions.items():
        vote = frame.select("series_id", F.lit(float(weights.get(name, 1.0))).alias("w"), (F.col("direction") * F.col("strength")).cast("double").alias("x"))
        votes = vote if votes is None else votes.unionByName(vote)
    score = divided(F.sum(F.col("w") * F.col("x")), F.sum(F.when(F.col("x").isNotNull(), F.col("w"))))
    return votes.groupBy("series_id").agg(F.count("x").alias("votes"), score.alias("score")).withColumn("direction", F.signum("score").cast("long"))
