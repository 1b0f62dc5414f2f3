"""Bars: building them from trades, checking, filling, aligning and looking them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError

from ..functions.columns import by_time, year_digit


def to_bars(trades: DataFrame, series: str, time: Column, price: str, order: list[str], volume: Column | None = None) -> DataFrame:
    """OHLCV bars (series_id, time, open, high, low, close, volume, t) of ``trades``:
    first and last price by ``order``, which must be total up to equal prices. One shuffle,
    with partial aggregation; then one window per series for the position ``t``."""
    key = F.struct(*order, price)
    volume = F.count("*") if volume is None else F.sum(volume)
    grouped = trades.groupBy(F.col(series).alias("series_id"), time.alias("time")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), volume.alias("volume")
    )
    return numbered(grouped)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("t", (F.row_number().over(by_time(order="time")) - 1).cast("long"))


def violation() -> Column:
    """Why a bar is invalid, or null: the first broken rule."""
    return (
        F.when(F.col("high") < F.col("low"), "high below low")
        .when((F.col("open") < F.col("low")) | (F.col("open") > F.col("high")), "open outside range")
        .when((F.col("close") < F.col("low")) | (F.col("close") > F.col("high")), "close outside range")
        .when(F.col("volume") < 0, "negative volume")
        .when(F.col("close") <= 0, "close not positive")
    )


def validated(bars: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid bars, quarantined bars with ``violation``). ``strict``: a bad bar fails the job."""
    marked = bars.withColumn("violation", violation())
    if strict:
        bad = F.raise_error(F.concat(F.lit("invalid bar: "), F.col("violation")))
        return bars.withColumn("close", F.when(violation().isNull(), F.col("close")).otherwise(bad.cast("double"))), marked.limit(0)
    return marked.where("violation IS NULL").drop("violation"), marked.where("violation IS NOT NULL")


def enriched(bars: DataFrame, instruments: DataFrame) -> DataFrame:
    """adjusted_close, year_digit, and the daily close of crypto instruments. The dimension
    is joined by whatever strategy its size allows."""
    joined = bars.join(instruments.select("series_id", "type", "day_close_utc"), "series_id", "left")
    return joined.withColumns(
        {"adjusted_close": F.col("close"), "year_digit": year_digit(F.col("time")), "day_close_utc": F.when(F.lower("type") == "crypto", F.col("day_close_utc"))}
    )


def gaps(bars: DataFrame, days: int = 5) -> DataFrame:
    """Stretches of more than ``days`` days without a bar."""
    last = F.lag("time").over(by_time(order="time"))
    return bars.select("series_id", last.alias("from_time"), F.col("time").alias("to_time"), F.datediff("time", last).alias("days")).where(F.col("days") > days)


def filled(bars: DataFrame) -> DataFrame:
    """A row for every day between first and last; prices carried forward, volume 0."""
    days = bars.groupBy("series_id").agg(F.sequence(F.min("time"), F.max("time")).alias("days"))
    calendar = days.select("series_id", F.explode("days").alias("time"))
    wide = calendar.join(bars.select("series_id", "time", "close", "volume"), ["series_id", "time"], "left")
    carried = F.last("close", ignorenulls=True).over(by_time((Window.unboundedPreceding, 0), order="time"))
    return wide.select("series_id", "time", carried.alias("close"), F.coalesce("volume", F.lit(0)).alias("volume"), F.col("close").isNull().alias("is_filled"))


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each series; Spark limits each group before the shuffle."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("time"))
    return bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def between(bars: DataFrame, series_id: str, start: str, end: str) -> DataFrame:
    """Range scan; both predicates reach the file scan."""
    return bars.where((F.col("series_id") == series_id) & F.col("time").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def deduplicated(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key, that with the largest ``newest``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))).where("_n = 1").drop("_n")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of ``changes`` replacing those of equal keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Closes of two frames at equal times."""
    a = left.select("time", F.col("close").alias("left_close"))
    return a.join(right.select("time", F.col("close").alias("right_close")), "time")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time.

    A union and a running last instead of a range join: one shuffle, sorted once.
    """
    wide = left.withColumns({"_value": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    quotes = right.select(*by, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = wide.unionByName(quotes, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("_value", ignorenulls=True).over(order)).where("_side = 1").drop("_side", "_value")


def completeness(bars: DataFrame, years: float) -> DataFrame:
    share = F.count("*") / F.lit(years * 252)
    return bars.groupBy("series_id").agg(F.least(F.lit(1.0), share).alias("completeness"))


def daily_aggregate(bars: DataFrame) -> DataFrame:
    """Mean and spread of closes and total volume by series and day."""
    day = F.to_date("time").alias("day")
    return bars.groupBy("series_id", day).agg(F.avg("close").alias("avg_close"), F.stddev_samp("close").alias("std_close"), F.sum("volume").alias("volume"))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and ``rows``, whose keys must be new. Keys are never null."""
    if rows.join(table.select(*keys), keys, "left_semi").isEmpty():
        return table.unionByName(rows)
    raise AnalysisError("MD001", "a row with this key exists")


def updated(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of ``changes`` in place of those of equal keys; changes without
    one are left out, and it is an error if that leaves none."""
    known = changes.join(table.select(*keys).distinct(), keys, "left_semi")
    if known.isEmpty():
        raise AnalysisError("MD002", "no row has this key")
    return upserted(table, known, keys)


def removed(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without rows of the keys in ``gone``; it is an error if there are none."""
    if table.join(gone.select(*keys), keys, "left_semi").isEmpty():
        raise AnalysisError("MD002", "no row has this key")
    return table.join(gone.select(*keys), keys, "left_anti")


def renormalized(bars: DataFrame, values: DataFrame, column: str = "normalized") -> DataFrame:
    """``bars`` with ``column`` set from ``values`` (series_id, time, ``column``; a row per
    bar at most) where those have one, kept elsewhere."""
    given = values.select("series_id", "time", F.col(column).alias("_given"))
    return bars.join(given, ["series_id", "time"], "left").withColumn(column, F.coalesce("_given", column)).drop("_given")
