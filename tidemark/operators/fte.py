"""Forecast-to-actual efficiency: how well a forecast tracks what came."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import TRADING_DAYS, average_rank, by_time, correlation, divided, log_return, pair, whole
from . import windows

#: Forecasts of a row from earlier rows only, as columns.
FORECASTS: dict[str, Callable[[int], Column]] = {
    "last_value": lambda season: F.lag("close").over(by_time()),
    "drift": lambda season: 2 * F.lag("close").over(by_time()) - F.lag("close", 2).over(by_time()),
    "moving_average": lambda season: F.avg("close").over(by_time((-season, -1))),
}


def forecast(bars: DataFrame, name: str, season: int = 252) -> DataFrame:
    """``bars`` with a column ``predicted``."""
    if name == "seasonal_naive":
        return bars.withColumn("predicted", F.lag("close", season).over(by_time()))
    if name not in FORECASTS:
        raise ValueError(f"unknown forecast: {name}")
    return bars.withColumn("predicted", FORECASTS[name](season))


def adaptive_threshold(bars: DataFrame, base: float = 0.08, weight: float = 0.5, short: int = 30, long: int = 252) -> DataFrame:
    """base * (1 + weight * (short vol / long vol - 1)), half of base at least; base where
    a volatility is missing or the long one is 0."""
    both = windows.terminal_volatility(bars, short, "short_vol").join(windows.terminal_volatility(bars, long, "long_vol"), "series_id")
    return both.withColumn("threshold", _adapted(F.col("short_vol"), F.col("long_vol"), base, weight))


def _adapted(short: Column, long: Column, base: float, weight: float) -> Column:
    ratio = divided(short, long)
    return F.coalesce(F.when(ratio.isNotNull(), F.greatest(F.lit(base * 0.5), F.lit(base) * (1 + F.lit(weight) * (ratio - 1)))), F.lit(base))


def rank_correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Per series: n, Pearson's r and Spearman's rho."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = both.withColumns({"_x": average_rank(F.col(x), ["series_id"]), "_y": average_rank(F.col(y), ["series_id"])})
    return ranks.groupBy("series_id").agg(F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("pearson"), correlation(F.col("_x"), F.col("_y")).alias("spearman"))


def kendall(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b per series, over rows that have both values; null where one of them
    never changes. A kernel sorts and counts each series, so no pairs are made."""
    kind = rows.schema["series_id"].dataType.simpleString()

    def tau(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.kendall(part["x"].to_numpy(float), part["y"].to_numpy(float))
        return pd.DataFrame({"series_id": part["series_id"].iloc[:1], "tau": pd.Series([found], dtype="float64", index=part.index[:1])})

    both = rows.select("series_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    return both.groupBy("series_id").applyInPandas(tau, f"series_id {kind}, tau double")


def tail_aligned(forecast: DataFrame, actual: DataFrame, predicted: str = "predicted", value: str = "close") -> DataFrame:
    """Forecast and actual of unlike length, row by row from their ends (``back`` is 0 for
    the last): as many rows per series as the shorter of the two has."""

    def numbered(df: DataFrame, column: str) -> DataFrame:
        return df.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("t"))) - 1).cast("long").alias("back"), column)

    return numbered(forecast, predicted).join(numbered(actual, value), ["series_id", "back"])


def p_values(rows: DataFrame, r: str = "pearson", n: str = "n") -> DataFrame:
    """``rows`` with the two-sided p-value of a correlation: a vectorized kernel on results."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else kernels.correlation_p(float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return rows.withColumn("p_value", p(r, n))


def direction_accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Share of rows where both moved, and the same way; 0 where none did."""
    w = by_time()
    a, p = F.signum(F.col(actual) - F.lag(actual).over(w)), F.signum(F.col(predicted) - F.lag(predicted).over(w))
    moves = rows.select("series_id", a.alias("a"), p.alias("p"))
    both = (F.col("a") != 0) & (F.col("p") != 0)
    return moves.groupBy("series_id").agg(F.coalesce(divided(F.count_if(both & (F.col("a") == F.col("p"))).cast("double"), F.count_if(both).cast("double")), F.lit(0.0)).alias("direction_accuracy"))


#: A seasonality is broken once its rolling correlation was at most this for so many rows.
BROKEN = (-0.1, 3)


def broken(rows: DataFrame, limit: float = BROKEN[0], least: int = BROKEN[1]) -> DataFrame:
    """Whether rolling correlation ``r`` stayed at or below ``limit`` for ``least`` rows."""
    counted = windows.runs(rows, F.col("r") <= limit, least)
    return counted.groupBy("series_id").agg(F.bool_or("triggered").alias("is_broken"), F.max("run").alias("longest"))


def validate(rows: DataFrame, base: float = 0.08, window: int = 63, least: int = 100) -> DataFrame:
    """One row per series (close, predicted): correlations, direction, rolling mean,
    threshold, whether its seasonality broke, a verdict and what it rests on. Series of
    fewer than ``least`` known rows, or fewer than ``window``, are INSUFFICIENT_DATA;
    series without a forecast have no row.

    All windows keep to a series, so its rows are exchanged once for all of them, and once
    more for Kendall's tau."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("t"))
    priced = rows.select("series_id", "t", "close", "predicted").withColumn("_log", log_return(F.col("close"), by_time())).withColumn("_n", F.row_number().over(newest))

    def volatility(width: int) -> Column:
        spread = F.stddev_samp(F.when(F.col("_n") <= width - 1, F.col("_log"))).over(whole())
        return F.when(F.count("*").over(whole()) >= width + 1, spread * F.sqrt(F.lit(float(TRADING_DAYS))))

    known = priced.withColumn("threshold", _adapted(volatility(30), volatility(252), base, 0.5)).where("predicted IS NOT NULL")
    known = known.withColumn("t", (F.row_number().over(by_time()) - 1).cast("long"))
    ran = windows.runs(windows.rolling_correlation(known, "close", "predicted", window), F.col("r") <= BROKEN[0], BROKEN[1])
    x, y = pair(F.col("close"), F.col("predicted"))
    w = by_time()
    every = ran.withColumns({
        "_x": average_rank(x, ["series_id"]), "_y": average_rank(y, ["series_id"]),
        "_a": F.signum(F.col("close") - F.lag("close").over(w)), "_p": F.signum(F.col("predicted") - F.lag("predicted").over(w)),
    })
    both = (F.col("_a") != 0) & (F.col("_p") != 0)
    hits = divided(F.count_if(both & (F.col("_a") == F.col("_p"))).cast("double"), F.count_if(both).cast("double"))
    found = every.groupBy("series_id").agg(
        F.count(x).alias("n"), correlation(x, y).alias("pearson"), correlation(F.col("_x"), F.col("_y")).alias("spearman"), F.coalesce(hits, F.lit(0.0)).alias("direction_accuracy"),
        F.avg("r").alias("rolling_mean"), F.stddev_pop("r").alias("rolling_std"), F.bool_or("triggered").alias("is_broken"), F.max("run").alias("longest"), F.max("threshold").alias("threshold"),
    )
    joined = p_values(found).join(kendall(rows, "close", "predicted").withColumnRenamed("tau", "kendall"), "series_id", "left")
    few = F.col("n") < max(least, window)
    valid = F.coalesce(F.col("pearson") >= F.col("threshold"), F.lit(False))
    verdict = F.when(few, "INSUFFICIENT_DATA").when(F.col("is_broken"), "BROKEN").when(valid, "VALID").otherwise("INVALID")
    shown = F.coalesce(F.format_number("pearson", 4), F.lit("none"))
    message = F.when(few, F.concat(F.lit("rows: "), F.col("n"), F.lit(f", needed: {max(least, window)}"))).otherwise(
        F.concat(F.lit("correlation "), shown, F.lit(", threshold "), F.format_number("threshold", 4), F.when(F.col("is_broken"), F.lit(", turned for some time")).otherwise(F.lit("")))
    )
    return joined.withColumns({"train_size": F.floor(F.col("n") * 0.7), "verdict": verdict, "message": message})


def splits(n: int, steps: int, window: int) -> list[tuple[int, int, int]]:
    """(step, train_end, test_end) of a walk forward: training grows, and the walk stops
    when a test would reach the end."""
    first = max(100, int(0.3 * n))
    out = []
    for s in range(steps):
        train_end = first + int((n - first) * (s + 1) / steps)
        test_end = min(n, train_end + 2 * window)
        if test_end >= n:
            break
        out.append((s, train_end, test_end))
    return out


def splits_by_length(rows: DataFrame, steps: int, window: int) -> DataFrame:
    """``splits`` of each series by its own number of rows: series_id, step, train_end, test_end."""
    sized = rows.groupBy("series_id").agg(F.count("*").alias("_n")).withColumn("_first", F.greatest(F.lit(100), F.floor(0.3 * F.col("_n"))))
    stepped = sized.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    ended = stepped.withColumn("train_end", F.col("_first") + F.floor((F.col("_n") - F.col("_first")) * (F.col("step") + 1) / F.lit(steps)))
    return ended.withColumn("test_end", F.least("_n", F.col("train_end") + 2 * window)).where("test_end < _n").drop("_n", "_first")


def walk_forward(rows: DataFrame, n: int | None = None, steps: int = 5, window: int = 63) -> DataFrame:
    """Per series and step: correlation and direction over the rows of the step's test. The
    walk covers the first ``n`` rows, or each series by its own length."""
    within = (F.col("t") >= F.col("train_end")) & (F.col("t") < F.col("test_end"))
    if n is None:
        tests = rows.join(splits_by_length(rows, steps, window), "series_id").where(within)
    else:
        table = rows.sparkSession.createDataFrame(splits(n, steps, window) or [(0, n, n)], "step long, train_end long, test_end long")
        tests = rows.join(F.broadcast(table), within)  # `steps` rows
    w = Window.partitionBy("series_id", "step").orderBy("t")
    moved = tests.withColumns({"_a": F.signum(F.col("close") - F.lag("close").over(w)), "_p": F.signum(F.col("predicted") - F.lag("predicted").over(w))})
    both = (F.col("_a") != 0) & (F.col("_p") != 0)
    hits = F.coalesce(divided(F.count_if(both & (F.col("_a") == F.col("_p"))).cast("double"), F.count_if(both).cast("double")), F.lit(0.0))
    return moved.groupBy("series_id", "step", "train_end", "test_end").agg(F.count("*").alias("n"), correlation(F.col("close"), F.col("predicted")).alias("pearson"), hits.alias("direction_accuracy"))


SCORES = "series_id string, step long, train_end long, test_end long, n long, pearson double, direction_accuracy double, status string, message string"


def walked(rows: DataFrame, forecaster: Callable[[np.ndarray, int], np.ndarray], steps: int = 5, window: int = 63) -> DataFrame:
    """``walk_forward`` with a forecaster of the user's: it gets the closes before a test in
    order and the number of rows asked for, and returns as many numbers. A step whose
    forecaster raises, or returns another number of values, is an INSUFFICIENT_DATA row
    with the error's name and text. A task holds one step's history."""
    stepped = rows.select("series_id", "t", F.col("close").cast("double").alias("close")).dropna(subset=["close"])
    tests = stepped.join(splits_by_length(rows, steps, window), "series_id").where(F.col("t") < F.col("test_end"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        first = part.iloc[0]
        before = part["t"] < first["train_end"]
        train, actual = part.loc[before, "close"].to_numpy(float), part.loc[~before, "close"].to_numpy(float)
        r, hits, status, message = None, None, "OK", ""
        try:
            guess = np.asarray(forecaster(train, len(actual)), dtype=float)
            if guess.shape != actual.shape:
                raise ValueError(f"{guess.size} values for {len(actual)} rows")
            if len(actual) >= 3 and actual.std() * guess.std() > 1e-12:
                r = float(np.corrcoef(actual, guess)[0, 1])
            a, p = np.sign(np.diff(actual)), np.sign(np.diff(guess))
            moved = (a != 0) & (p != 0)
            hits = float((a == p)[moved].mean()) if moved.any() else 0.0
        except Exception as error:  # any failure of the user's function is that step's result
            status, message = "INSUFFICIENT_DATA", f"{type(error).__name__}: {error}"
        row = (first["series_id"], first["step"], first["train_end"], first["test_end"], len(actual), r, hits, status, message)
        return pd.DataFrame([row], columns=[c.split()[0] for c in SCORES.split(", ")]).astype({"pearson": "float64", "direction_accuracy": "float64"})

    return tests.groupBy("series_id", "step").applyInPandas(score, SCORES)


def aggregated(results: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Counts, spread of correlations and mean direction accuracy over all results; with
    ``validate``'s results also the mean of Spearman's rho and how many are broken."""
    valid = F.coalesce(F.col("pearson") >= threshold, F.lit(False))
    more = [F.avg("spearman").alias("mean_spearman")] if "spearman" in results.columns else []
    more += [F.count_if("is_broken").alias("broken_count")] if "is_broken" in results.columns else []
    return results.agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid_count"), F.avg("pearson").alias("mean_r"), F.stddev_pop("pearson").alias("std_r"), F.min("pearson").alias("min_r"),
        F.max("pearson").alias("max_r"), F.avg(valid.cast("double")).alias("valid_ratio"), F.avg("direction_accuracy").alias("direction_accuracy"), *more,
    )
