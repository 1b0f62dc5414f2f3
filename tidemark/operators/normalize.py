"""Normalization: percentile ranks, z-scores, ranges, their inverses and chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, divided, interpolated, percentile_rank, whole


def ranked(rows: DataFrame, value: str, kind: str = "mean", low: float = 0.0, high: float = 1.0, name: str = "prank") -> DataFrame:
    share = percentile_rank(F.col(value), ["series_id"], kind)
    return rows.withColumn(name, low + share * (high - low))


def unranked(rows: DataFrame, rank: str, of: str, name: str = "value") -> DataFrame:
    """Values back from ranks through the quartiles of ``of``."""
    points = [(F.lit(p), F.percentile(of, F.lit(p)).over(whole())) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    named = rows.withColumns({f"_q{i}": y for i, (_, y) in enumerate(points)})
    steps = [(x, F.col(f"_q{i}")) for i, (x, _) in enumerate(points)]
    return named.withColumn(name, interpolated(F.col(rank), steps)).drop(*[f"_q{i}" for i in range(len(points))])


def zscored(rows: DataFrame, value: str, ddof: int = 1, limit: float | None = None, name: str = "z") -> DataFrame:
    spread = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(whole())
    z = F.when(spread > 1e-12, divided(F.col(value) - F.avg(value).over(whole()), spread)).otherwise(F.lit(0.0))
    z = F.when(F.col(value).isNotNull(), z)
    return rows.withColumn(name, clip(z, -limit, limit) if limit else z)


def unscored(rows: DataFrame, z: str, of: str, name: str = "value") -> DataFrame:
    return rows.withColumn(name, F.col(z) * F.stddev_samp(of).over(whole()) + F.avg(of).over(whole()))


def scaled(rows: DataFrame, value: str, low: float = 0.0, high: float = 1.0, name: str = "scaled") -> DataFrame:
    least, most = F.min(value).over(whole()), F.max(value).over(whole())
    x = F.when(most > least, low + divided(F.col(value) - least, most - least) * (high - low)).otherwise(F.lit((low + high) / 2))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), clip(x, low, high)))


def unscaled(rows: DataFrame, x: str, of: str, low: float = 0.0, high: float = 1.0, name: str = "value") -> DataFrame:
    least, most = F.min(of).over(whole()), F.max(of).over(whole())
    return rows.withColumn(name, least + (F.col(x) - low) / F.lit(high - low) * (most - least))


def interquartile(rows: DataFrame, value: str, name: str = "iqr") -> DataFrame:
    """(x - first quartile) / interquartile range; 0 where that is nothing."""
    low, high = F.percentile(value, F.lit(0.25)).over(whole()), F.percentile(value, F.lit(0.75)).over(whole())
    x = F.when(high - low > 1e-10, divided(F.col(value) - low, high - low)).otherwise(F.lit(0.0))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), x))


#: Ranges below which a series counts as constant before it is warped.
CONSTANT = 1e-10


def for_warping(rows: DataFrame, value: str, method: str = "zscore", name: str = "shape") -> DataFrame:
    """``value`` of each series in the form in which shapes are compared: ``zscore`` (by the
    population's deviation), ``minmax``, ``percentile`` (from the first quartile, by the range
    between quartiles) or ``none``. A constant series is all 0, but as it is with ``none``;
    nulls stay null."""
    x = F.col(value)
    if method == "none":
        return rows.withColumn(name, x.cast("double"))
    if method == "zscore":
        origin, scale = F.avg(x).over(whole()), F.stddev_pop(x).over(whole())
    elif method == "minmax":
        origin = F.min(x).over(whole())
        scale = F.max(x).over(whole()) - origin
    elif method == "percentile":
        origin = F.percentile(x, F.lit(0.25)).over(whole())
        scale = F.percentile(x, F.lit(0.75)).over(whole()) - origin
    else:
        raise ValueError(f"unknown method: {method}")
    shape = F.when(scale >= CONSTANT, divided(x - origin, scale)).otherwise(F.lit(0.0))
    return rows.withColumn(name, F.when(x.isNotNull(), shape))


METHODS: dict[str, Callable[..., DataFrame]] = {"prank": ranked, "zscore": zscored, "minmax": scaled}


def normalized(rows: DataFrame, value: str, method: str, **options: object) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](rows, value, **options)


def chain(rows: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Rank, then z-score within ``limit``, then range: column ``normalized``."""
    ranks = ranked(rows, value, name="_rank")
    scores = zscored(ranks, "_rank", limit=limit, name="_score")
    return scaled(scores, "_score", name="normalized").drop("_rank", "_score")


def validation(rows: DataFrame, value: str, result: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Per series: whether nulls agree, results are in range, and neighbours keep order."""
    step, moved = F.col(value) - F.lag(value).over(by_time()), F.col(result) - F.lag(result).over(by_time())
    kept = F.coalesce(F.signum(step) * F.signum(moved) >= 0, F.lit(True))
    inside = F.coalesce(F.col(result).between(low - 1e-6, high + 1e-6), F.lit(True))
    marked = rows.withColumns({"_n": F.col(value).isNull() == F.col(result).isNull(), "_i": inside, "_o": kept})
    return marked.groupBy("series_id").agg(F.bool_and("_n").alias("nulls_agree"), F.bool_and("_i").alias("in_range"), F.bool_and("_o").alias("monotonic"))
