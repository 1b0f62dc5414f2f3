"""Volatility regimes and forecast-to-earnings thresholds of single series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, correlation, divided
from . import rolling, windows

REGIMES = ("LOW", "NORMAL", "HIGH", "EXTREME")
FACTORS = {"LOW": 1.0, "NORMAL": 1.0, "HIGH": 1.2, "EXTREME": 1.5}


def regime_of(percentile: Column) -> Column:
    return F.when(percentile < 0.25, "LOW").when(percentile < 0.75, "NORMAL").when(percentile < 0.95, "HIGH").otherwise("EXTREME")


def factor(regime: Column) -> Column:
    return F.when(regime == "HIGH", F.lit(FACTORS["HIGH"])).when(regime == "EXTREME", F.lit(FACTORS["EXTREME"])).otherwise(F.lit(1.0))


def regimes(bars: DataFrame, width: int = 21, baseline: int = 252, base: float = 0.08, weight: float = 0.5) -> DataFrame:
    """One row per series: current and baseline volatility, percentile, regime, threshold
    and confidence. Series of fewer than 60 rows are INSUFFICIENT."""
    vols = windows.realized_volatility(bars, width)
    newest = Window.partitionBy("series_id").orderBy(F.desc("t"))
    ranked = vols.withColumn("_n", F.row_number().over(newest)).withColumn("current", F.first("vol").over(newest))
    recent = F.when(F.col("_n") <= baseline, F.col("vol"))
    found = ranked.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max("current").alias("current_vol"), F.avg(recent).alias("baseline_vol"), F.stddev_pop(recent).alias("_std"),
        divided(F.count_if(F.col("vol") <= F.col("current")), F.count("vol")).alias("percentile"),
    )
    percentile = F.coalesce("percentile", F.lit(0.5))
    ratio = F.coalesce(divided(F.col("current_vol"), F.col("baseline_vol")), F.lit(1.0))
    adaptive = F.greatest(F.lit(base * 0.5), F.lit(base) * (1 + F.lit(weight) * (ratio - 1)))
    spread = F.coalesce(divided(F.col("_std"), F.col("baseline_vol")), F.lit(0.0))
    confidence = clip((1 - spread + F.least(F.lit(1.0), F.col("n") / 504)) / 2, 0.0, 1.0)
    named = found.withColumn("percentile", percentile).withColumn("regime", F.when(F.col("n") < 60, "INSUFFICIENT").otherwise(regime_of(F.col("percentile"))))
    return named.select("series_id", "n", "current_vol", "baseline_vol", "percentile", "regime", (adaptive * factor(F.col("regime"))).alias("threshold"), confidence.alias("confidence"))


def validity(signals: DataFrame, threshold: str = "threshold", score: str = "score") -> DataFrame:
    """Whether a score reaches its threshold, and its strength."""
    strength = F.least(F.lit(1.0), F.coalesce(divided(F.col(score), F.col(threshold)), F.lit(0.0)))
    return signals.withColumns({"is_valid": F.col(score) >= F.col(threshold), "strength": strength})


def transitions(vols: DataFrame, current: DataFrame, points: int = 50) -> DataFrame:
    """Probabilities of each regime next: staying is likelier, and a clear trend of the
    last ``points`` volatilities shifts some to the neighbour it points to. Uniform for
    series with fewer volatilities."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("t"))
    last = vols.where("vol IS NOT NULL").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= points)
    trend = last.groupBy("series_id").agg(F.count("*").alias("k"), F.regr_slope("vol", "t").alias("slope"), correlation(F.col("t").cast("double"), F.col("vol")).alias("r"))
    level = F.array_position(F.array(*map(F.lit, REGIMES)), F.col("regime")) - 1
    rows = current.select("series_id", level.alias("level")).join(trend, "series_id", "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(3))))
    step = F.when(F.col("r") > 0.3, 1).when(F.col("r") < -0.3, -1).otherwise(0)
    ahead = F.least(F.lit(3), F.greatest(F.lit(0), F.col("level") + step))
    weight = F.when(F.col("to") == F.col("level"), 0.6).otherwise(0.1) + F.when((ahead != F.col("level")) & (F.col("to") == ahead), 0.2).otherwise(0.0) - F.when((ahead != F.col("level")) & (F.col("to") == F.col("level")), 0.2).otherwise(0.0)
    weighed = rows.withColumn("w", F.when(F.coalesce("k", F.lit(0)) < points, F.lit(0.25)).otherwise(weight))
    total = F.sum("w").over(Window.partitionBy("series_id"))
    return weighed.select("series_id", F.element_at(F.array(*map(F.lit, REGIMES)), F.col("to") + 1).alias("regime"), (F.col("w") / total).alias("probability"))


def signal_series(bars: DataFrame, base: float = 0.08, width: int = 21, least: int = 3) -> DataFrame:
    """Regime at every row from the history so far (expanding weak percentile), and runs
    of calm rows. Long series are counted by blocks of times and values."""
    vols = windows.realized_volatility(bars, width).where("vol IS NOT NULL").select("series_id", "t", "vol")
    shares = rolling.percentile_so_far(vols, "vol")
    named = shares.withColumn("regime", regime_of(F.col("percentile")))
    marked = named.withColumn("threshold", F.lit(base) * factor(F.col("regime")))
    return windows.runs(marked, F.col("regime").isin("LOW", "NORMAL"), least)


def summary(results: DataFrame) -> DataFrame:
    """How many series are in each of the four regimes, and their mean threshold."""
    names = results.sparkSession.createDataFrame([(x,) for x in REGIMES], "regime string")
    counts = results.groupBy("regime").agg(F.count("*").alias("n"), F.avg("threshold").alias("mean_threshold"))
    return names.join(counts, "regime", "left").select("regime", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_threshold")


def totals(results: DataFrame, signals: DataFrame) -> DataFrame:
    """One row over ``results`` (regime, threshold, is_valid) and ``signals`` (triggered):
    series, valid ones, a count of each regime, mean threshold, signal rows triggered."""
    counts = [F.count_if(F.col("regime") == x).alias(x.lower()) for x in REGIMES]
    found = results.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), *counts, F.avg("threshold").alias("mean_threshold"))
    fired = signals.agg(F.count_if("triggered").alias("triggered"))
    return found.join(F.broadcast(fired))  # one row each


def merged(results: DataFrame, found: DataFrame, score: str = "pearson") -> DataFrame:
    """``results`` of a forecast's validation (series_id, ``score``; null counts 0) with the
    fields of ``regimes``: verdict and strength against the regime's threshold."""
    ratio = F.coalesce(divided(F.col("current_vol"), F.col("baseline_vol")), F.lit(1.0))
    fields = found.select(
        "series_id", "regime", F.col("confidence").alias("regime_confidence"), (F.col("threshold") / factor(F.col("regime"))).alias("adaptive_threshold"),
        F.col("threshold").alias("regime_adjusted_threshold"), ratio.alias("volatility_ratio"),
    )
    joined = results.join(fields, "series_id", "left").withColumn("_score", F.coalesce(score, F.lit(0.0)))
    return validity(joined, "regime_adjusted_threshold", "_score").drop("_score").withColumnsRenamed({"is_valid": "regime_validated", "strength": "signal_strength"})
