"""Returns, rolling statistics, runs, extrema and drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    TRADING_DAYS,
    by_time,
    clip,
    correlation,
    divided,
    log_return,
    rolling_rank,
    run_length,
    simple_return,
    trailing,
)


def returns(bars: DataFrame, value: str = "close") -> DataFrame:
    """diff, ret (simple) and logret against the row before."""
    w, x = by_time(), F.col(value)
    return bars.withColumns({"diff": x - F.lag(x).over(w), "ret": simple_return(x, w), "logret": log_return(x, w)})


def realized_volatility(bars: DataFrame, width: int = 21, value: str = "close", name: str = "vol") -> DataFrame:
    """Annualized population deviation of the last ``width`` log returns; null before."""
    with_returns = bars.withColumn("_r", log_return(F.col(value), by_time()))
    enough = (F.col("t") >= width) & (F.count("_r").over(trailing(width)) >= width // 2)
    vol = F.stddev_pop("_r").over(trailing(width)) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return with_returns.withColumn(name, F.when(enough, vol)).drop("_r")


def terminal_volatility(bars: DataFrame, width: int, name: str = "vol") -> DataFrame:
    """Per series: annualized sample deviation of the last width-1 log returns; null for
    series of fewer than width+1 rows."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("t"))
    rows = bars.withColumn("_r", log_return(F.col("close"), by_time())).withColumn("_n", F.row_number().over(newest))
    found = F.stddev_samp(F.when(F.col("_n") <= width - 1, F.col("_r"))) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return rows.groupBy("series_id").agg(F.when(F.count("*") >= width + 1, found).alias(name))


def rolling_correlation(rows: DataFrame, x: str, y: str, width: int) -> DataFrame:
    """``r`` over full frames of ``width`` rows."""
    full = F.count("*").over(trailing(width)) == width
    return rows.withColumn("r", F.when(full, correlation(F.col(x), F.col(y), trailing(width))))


def rolling_percentile(rows: DataFrame, value: str, width: int, kind: str = "mean") -> DataFrame:
    return rows.withColumn("pct", rolling_rank(F.col(value), trailing(width), kind))


def rolling_zscore(rows: DataFrame, value: str, width: int, ddof: int = 1, limit: float | None = None) -> DataFrame:
    w = trailing(width)
    spread = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(w)
    z = F.when(F.count(value).over(w) >= 2, F.when(spread > 0, divided(F.col(value) - F.avg(value).over(w), spread)).otherwise(F.lit(0.0)))
    z = F.when(F.col(value).isNotNull(), z)
    return rows.withColumn("z", clip(z, -limit, limit) if limit else z)


def rolling_minmax(rows: DataFrame, value: str, width: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    w = trailing(width)
    least, most = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(most > least, low + divided(F.col(value) - least, most - least) * (high - low)).otherwise(F.lit((low + high) / 2))
    return rows.withColumn("scaled", F.when(F.col(value).isNotNull() & (F.count(value).over(w) >= 2), scaled))


def runs(rows: DataFrame, holds: Column, least: int) -> DataFrame:
    """``run``: how many rows in a row ``holds`` so far; ``triggered``: at least ``least``."""
    island, step = run_length(holds, by_time())
    marked = rows.withColumns({"_island": island, "_step": step})
    inside = Window.partitionBy("series_id", "_island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run", F.sum("_step").over(inside)).withColumn("triggered", F.col("run") >= least).drop("_island", "_step")


def extended(rows: DataFrame, steps: int, kind: str = "pad", value: str = "close") -> DataFrame:
    """``rows`` (series_id, t, ``value``) and ``steps`` more of each series: the last value
    again (pad), or on with the last difference (extrapolate; a series of one row is
    padded). ``added`` tells them apart."""
    if kind not in ("pad", "extrapolate"):
        raise ValueError(f"unknown kind of extension: {kind}")
    kept = rows.select("series_id", F.col("t").cast("long").alias("t"), value, F.lit(False).alias("added"))
    slope = F.col(value) - F.lag(value).over(by_time())
    ends = rows.withColumn("_slope", slope).groupBy("series_id").agg(F.max("t").cast("long").alias("_t"), F.max_by(value, "t").alias("_x"), F.max_by("_slope", "t").alias("_slope"))
    by = F.coalesce("_slope", F.lit(0.0)) if kind == "extrapolate" else F.lit(0.0)
    more = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps)) if steps > 0 else F.array().cast("array<int>")))
    return kept.unionByName(more.select("series_id", (F.col("_t") + F.col("_k")).alias("t"), (F.col("_x") + F.col("_k") * by).alias(value), F.lit(True).alias("added")))


#: Rows that an analysis needs at least.
GUARDS = {"spectrum": 50, "forecast": 100, "rolling": 21, "regime": 60, "analogies": 20}


def guarded(rows: DataFrame) -> DataFrame:
    """Per series and analysis: its rows, the rows needed, and OK or INSUFFICIENT_DATA."""
    asked = F.explode(F.create_map(*[F.lit(x) for item in GUARDS.items() for x in item])).alias("analysis", "least")
    sized = rows.groupBy("series_id").agg(F.count("*").alias("n")).select("series_id", "n", asked)
    return sized.withColumn("status", F.when(F.col("n") < F.col("least"), "INSUFFICIENT_DATA").otherwise("OK"))


def blocks(rows: DataFrame, count: int = 5) -> DataFrame:
    """``block`` 0..count-1: equal blocks by position; the tail is left out."""
    sized = rows.withColumn("_size", F.floor(F.count("*").over(Window.partitionBy("series_id")) / count))
    cut = sized.withColumn("block", F.floor(F.col("t") / F.nullif("_size", F.lit(0))))
    return cut.where(F.col("block") < count).drop("_size")


def sliding(rows: DataFrame, width: int, step: int) -> DataFrame:
    """Every row once for each window of ``width`` rows that it lies in (``start``)."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / step) * step)
    last = F.least(F.floor(F.col("t") / step) * step, F.floor((n - width) / step) * step)
    starts = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")))
    return rows.withColumn("_starts", starts).withColumn("start", F.explode("_starts")).drop("_starts")


def equity(rows: DataFrame, ret: str = "ret") -> DataFrame:
    """equity (compounded), peak and drawdown."""
    w = by_time((Window.unboundedPreceding, 0))
    grown = rows.withColumn("equity", F.exp(F.sum(F.coalesce(F.log1p(ret), F.lit(0.0))).over(w)))
    return grown.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def turning_points(rows: DataFrame, value: str = "close") -> DataFrame:
    """``kind``: BOTTOM where both neighbours are higher, TOP where both are lower."""
    x, before, after = F.col(value), F.lag(value).over(by_time()), F.lead(value).over(by_time())
    kind = F.when((x < before) & (x < after), "BOTTOM").when((x > before) & (x > after), "TOP")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL")


def recent_ratio(rows: DataFrame, value: str, short_days: int = 7, long_days: int = 30, share: float = 0.8) -> DataFrame:
    """Means over the last days by time, and whether the short one fell below ``share``
    of the long one."""
    seconds = F.col("time").cast("timestamp").cast("long")
    rows = rows.withColumn("_s", seconds)

    def mean(days: int) -> Column:
        return F.avg(value).over(Window.partitionBy("series_id").orderBy("_s").rangeBetween(-days * 86400, 0))

    return rows.withColumns({"short_mean": mean(short_days), "long_mean": mean(long_days)}).withColumn("alert", F.col("short_mean") < F.col("long_mean") * share).drop("_s")


def interpolated(rows: DataFrame, value: str) -> DataFrame:
    """``filled``: nulls between known rows on the straight line, nulls after the last as
    the last, nulls before the first kept."""
    back, ahead = by_time((Window.unboundedPreceding, 0)), by_time((0, Window.unboundedFollowing))
    at = F.when(F.col(value).isNotNull(), F.col("t"))
    x0, t0 = F.last(value, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(back)
    x1, t1 = F.first(value, ignorenulls=True).over(ahead), F.first(at, ignorenulls=True).over(ahead)
    line = x0 + (x1 - x0) * divided((F.col("t") - t0).cast("double"), (t1 - t0).cast("double"))
    return rows.withColumn("filled", F.coalesce(F.col(value), line, x0))


def compounded(bars: DataFrame, scale: float, per_year: float = 252.0) -> DataFrame:
    """Per series, over all its returns: the total of ``scale`` times each, compounded as a
    sum of logarithms, and the Sharpe ratio of log returns."""
    total = F.expm1(F.sum(F.log1p(F.col("ret") * scale)))
    sharpe = divided(F.avg("logret"), F.stddev_pop("logret")) * F.sqrt(F.lit(per_year))
    return returns(bars).groupBy("series_id").agg(total.alias("total"), sharpe.alias("sharpe"))
