"""Structural breaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import by_time, divided


def _rss(y: Column, x: Column) -> Column:
    return F.regr_syy(y, x) - F.coalesce(divided(F.pow(F.regr_sxy(y, x), F.lit(2.0)), F.regr_sxx(y, x)), F.lit(0.0))


def chow(rows: DataFrame, share: float = 0.5, value: str = "close") -> DataFrame:
    """Chow's F for a break of the linear trend at ``share`` of each series: one pass of
    sums, no second fit."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    left = F.col("t") < F.floor(n * share)
    rows = rows.withColumn("_left", left)
    x, y = F.col("t").cast("double"), F.col(value)

    def side(c: Column, on: Column) -> Column:
        return F.when(on, c)

    found = rows.groupBy("series_id").agg(
        F.count("*").alias("n"), _rss(y, x).alias("rss"), _rss(side(y, F.col("_left")), side(x, F.col("_left"))).alias("rss1"), _rss(side(y, ~F.col("_left")), side(x, ~F.col("_left"))).alias("rss2")
    )
    split = F.col("rss1") + F.col("rss2")
    return found.select("series_id", "n", divided((F.col("rss") - split) / 2, split / (F.col("n") - 4)).alias("f"))


def chow_p(found: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(f: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else kernels.f_test_p(float(a), 2, int(b) - 4) for a, b in zip(f, n, strict=True)], dtype="float64")

    return found.withColumn("p_value", p("f", "n"))


def trend_breaks(bars: DataFrame, directions: DataFrame, width: int = 20) -> DataFrame:
    """Closes beyond the range of the ``width`` bars before; confirmed where the composite
    line (series_id, t, direction) points the same way."""
    w = by_time((-width, -1))
    up, down = F.col("close") > F.max("high").over(w), F.col("close") < F.min("low").over(w)
    side = F.when(up, 1).when(down, -1).cast("long")
    found = bars.select("series_id", "t", "close", side.alias("side"), F.count("*").over(w).alias("_n")).where((F.col("_n") == width) & F.col("side").isNotNull())
    joined = found.drop("_n").join(directions.select("series_id", "t", "direction"), ["series_id", "t"], "left")
    return joined.select("series_id", "t", "close", "side", F.coalesce(F.col("side") == F.col("direction"), F.lit(False)).alias("confirmed"))
