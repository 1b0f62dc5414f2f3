"""The whole analysis of a set of instruments, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trailing
from . import backtest, bootstrap, cycles, detrend, fte, positioning, regime, seasonality, windows


def analyze(bars: DataFrame, current_year: int, iterations: int = 100, low: int = 10, high: int = 40) -> DataFrame:
    """Backtest of a trend rule, decennial seasonality, dominant cycle, forecast validity,
    regime, interval of the mean return, position size and lineage, joined by series.

    ``bars`` is read by every step: pass a table or a cached frame. Each step ends in one
    row per series, so the joins at the end are small.
    """
    signal = F.when(F.col("close") > F.avg("close").over(trailing(20)), 1.0).otherwise(0.0)
    tested = backtest.metrics(backtest.simulated(bars.withColumn("signal", signal))).select("series_id", "total_return", "sharpe", "max_drawdown", "win_rate")
    season = seasonality.decennial(bars, current_year, least_years=7).select("series_id", F.col("trend").alias("decennial_trend"), F.col("status").alias("decennial_status"))
    wave = cycles.dominant(cycles.correlations(detrend.preprocessed(bars).select("series_id", "t", "x"), low, high), 1).select("series_id", F.col("period").alias("cycle_period"), F.col("energy").alias("cycle_energy"))
    tracked = fte.rank_correlations(fte.forecast(bars, "moving_average", 21), "close", "predicted").select("series_id", F.col("pearson").alias("fte"))
    calm = regime.regimes(bars).select("series_id", "regime", "threshold", "confidence")
    sure = bootstrap.interval(windows.returns(bars), iterations).select("series_id", F.col("lower").alias("ret_lower"), F.col("upper").alias("ret_upper"), "p_value")
    last = bars.groupBy("series_id").agg(F.max_by("close", "t").alias("entry"))
    traces = backtest.source_hash(bars, ["series_id"], ["time", "close", "volume"]).select("series_id", F.col("hash").alias("source_hash"), "row_count")
    joined = tested
    for part in (season, wave, tracked, calm, sure, last, traces):
        joined = joined.join(part, "series_id", "left")
    trade = joined.withColumns({"stop": F.col("entry") * 0.95, "target": F.col("entry") * 1.10, "balance": F.lit(100_000.0), "drawdown": F.col("max_drawdown")})
    sized = positioning.position_size(trade).drop("balance", "drawdown", "potential_loss", "potential_gain")
    valid = (F.col("fte") >= F.col("threshold")) & (F.col("sharpe") > 0) & (F.col("size") > 0)
    return sized.withColumn("signal", F.when(F.coalesce(valid, F.lit(False)), "BUY").otherwise("NONE"))
