"""Detrending and decomposition."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import by_time, trailing, whole

#: Usual smoothing by frequency of the data.
SMOOTHING = {"annual": 100.0, "quarterly": 1600.0, "monthly": 14400.0, "weekly": 100000.0, "daily": 160000.0}


def linear(rows: DataFrame, value: str = "close", partition: list[str] | None = None, name: str = "detrended") -> DataFrame:
    """``trend`` by least squares on ``t`` and what is left."""
    w = Window.partitionBy(*(partition or ["series_id"]))
    slope, intercept = F.regr_slope(F.col(value), F.col("t")).over(w), F.regr_intercept(F.col(value), F.col("t")).over(w)
    fitted = rows.withColumn("trend", F.coalesce(intercept + slope * F.col("t"), F.avg(value).over(w)))
    return fitted.withColumn(name, F.col(value) - F.col("trend"))


def difference(rows: DataFrame, value: str = "close", name: str = "detrended") -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.lag(value).over(by_time()))


def moving_average(rows: DataFrame, value: str = "close", period: int = 252, name: str = "detrended") -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.avg(value).over(trailing(period)))


COMPONENTS = "series_id string, t bigint, original double, trend double, seasonal double, residual double"


def _by_series(rows: DataFrame, value: str, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A kernel over each series in time order: one series is one task's unit."""
    narrow = rows.where(F.col(value).isNotNull()).select("series_id", F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("original"))
    return narrow.groupBy("series_id").applyInPandas(lambda part: kernel(part.sort_values("t").reset_index(drop=True)), schema)


def hodrick_prescott(rows: DataFrame, value: str = "close", frequency: str = "daily", smoothing: float | None = None) -> DataFrame:
    """original, trend, cycle; series of fewer than 3 rows are left out."""
    weight = SMOOTHING.get(frequency, SMOOTHING["daily"]) if smoothing is None else smoothing

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 3:
            return part.iloc[:0].assign(trend=0.0, cycle=0.0)
        trend = kernels.hodrick_prescott(part["original"].to_numpy(), weight)
        return part.assign(trend=trend, cycle=part["original"] - trend)

    return _by_series(rows, value, kernel, "series_id string, t bigint, original double, trend double, cycle double")


def stl(rows: DataFrame, value: str = "close", period: int = 12, seasonal: int = 7, robust: bool = False) -> DataFrame:
    """original, trend, seasonal, residual; series of fewer than two periods are left out."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 2 * period:
            return part.iloc[:0].assign(trend=0.0, seasonal=0.0, residual=0.0)
        trend, season, rest = kernels.stl(part["original"].to_numpy(), period, seasonal, robust=robust)
        return part.assign(trend=trend, seasonal=season, residual=rest)

    return _by_series(rows, value, kernel, COMPONENTS)


METHODS: dict[str, Callable[..., DataFrame]] = {"linear": linear, "difference": difference, "ma": moving_average, "hp": hodrick_prescott, "stl": stl}


def detrended(rows: DataFrame, method: str, **options: object) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](rows, **options)


def validation(rows: DataFrame, value: str, result: str) -> DataFrame:
    """Per series: nulls made, variance ratio, shift of the mean; ok unless nulls were made."""
    lost = F.count_if(F.col(value).isNotNull() & F.col(result).isNull())
    ratio = F.var_pop(result) / F.nullif(F.var_pop(value), F.lit(0.0))
    return rows.groupBy("series_id").agg(lost.alias("lost"), ratio.alias("variance_ratio"), (F.avg(result) - F.avg(value)).alias("mean_shift")).withColumn("ok", F.col("lost") == 0)


def preprocessed(rows: DataFrame, value: str = "close") -> DataFrame:
    """Linear trend off, then unit population deviation: column ``x``, ready for spectra."""
    flat = linear(rows, value)
    spread = F.stddev_pop("detrended").over(whole())
    x = F.when(spread > 1e-12, (F.col("detrended") - F.avg("detrended").over(whole())) / F.when(spread > 1e-12, spread)).otherwise(F.lit(0.0))
    return flat.withColumn("x", x)
