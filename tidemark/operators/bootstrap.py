"""Bootstrap intervals and tests.

Draws are a function of (iteration, position): the first eight hex digits of an md5,
modulo n. Every engine and every retry of a task draws alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRADING_DAYS, divided

STATISTICS = {
    "mean": lambda x: F.avg(x),
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "sharpe": lambda x: F.coalesce(divided(F.avg(x), F.stddev_pop(x)), F.lit(0.0)) * F.sqrt(F.lit(float(TRADING_DAYS))),
    "total_return": lambda x: F.exp(F.sum(F.log1p(x))) - 1,
}


def statistic(name: str, x: str) -> Column:
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic: {name}")
    return STATISTICS[name](x)


def draw(iteration: Column, position: Column, n: Column) -> Column:
    key = F.concat(iteration.cast("string"), F.lit("-"), position.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def resamples(rows: DataFrame, iterations: int, value: str = "ret", name: str = "mean") -> DataFrame:
    """(series_id, iteration, b): the statistic of each resample. The expansion is joined
    and aggregated at once, by (series, iteration)."""
    known = rows.where(F.col(value).isNotNull()).select("series_id", F.col(value).alias("x"), (F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1).cast("long").alias("p"))
    sizes = known.groupBy("series_id").agg(F.count("*").alias("n"))
    wide = known.select("series_id", "p").join(sizes, "series_id").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    picks = wide.select("series_id", "iteration", draw(F.col("iteration"), F.col("p"), F.col("n")).alias("p"))
    return picks.join(known, ["series_id", "p"]).groupBy("series_id", "iteration").agg(statistic(name, "x").alias("b"))


def interval(rows: DataFrame, iterations: int = 1000, level: float = 0.95, value: str = "ret", name: str = "mean", null: float = 0.0) -> DataFrame:
    """Per series: the statistic, its percentile interval, standard error and two-sided p
    against ``null``."""
    drawn = resamples(rows, iterations, value, name)
    own = rows.where(F.col(value).isNotNull()).groupBy("series_id").agg(statistic(name, value).alias("estimate"))
    tail = (1 - level) / 2
    joined = drawn.join(own, "series_id")
    p = F.avg((F.abs(F.col("b") - F.col("estimate")) >= F.abs(F.lit(null) - F.col("estimate"))).cast("double"))
    return joined.groupBy("series_id", "estimate").agg(
        F.percentile("b", F.lit(tail)).alias("lower"), F.percentile("b", F.lit(1 - tail)).alias("upper"), F.stddev_pop("b").alias("std_error"), p.alias("p_value")
    )


def corrected(rows: DataFrame, iterations: int = 1000, level: float = 0.95, value: str = "ret") -> DataFrame:
    """Bias-corrected and accelerated interval of the mean. The jackknife of a mean needs
    no resampling: it leaves (sum - x) / (n - 1)."""
    drawn = resamples(rows, iterations, value, "mean")
    known = rows.where(F.col(value).isNotNull()).select("series_id", F.col(value).alias("x"))
    sums = known.groupBy("series_id").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.avg("x").alias("estimate"))
    left = known.join(sums, "series_id").withColumn("d", F.col("estimate") - divided(F.col("s") - F.col("x"), (F.col("n") - 1).cast("double")))
    curve = left.groupBy("series_id").agg(divided(F.sum(F.col("d") * F.col("d") * F.col("d")), 6 * F.pow(F.sum(F.col("d") * F.col("d")), F.lit(1.5))).alias("a"))
    below = drawn.join(sums, "series_id").groupBy("series_id", "estimate").agg(F.avg((F.col("b") < F.col("estimate")).cast("double")).alias("below"), F.sort_array(F.collect_list("b")).alias("b"))
    joined = below.join(curve, "series_id")

    @F.pandas_udf("struct<lower:double,upper:double>")
    def bounds(below: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        normal, out = NormalDist(), []
        for share, curve, draws in zip(below, a, b, strict=True):
            ends = []
            for tail in ((1 - level) / 2, (1 + level) / 2):
                if 0 < share < 1 and not pd.isna(curve):
                    z0, z = normal.inv_cdf(share), normal.inv_cdf(tail)
                    bend = 1 - curve * (z0 + z)
                    tail = normal.cdf(z0 + (z0 + z) / bend) if bend else tail
                ends.append(float(pd.Series(draws).quantile(tail)))
            out.append(ends)
        return pd.DataFrame(out, columns=["lower", "upper"])

    return joined.withColumn("i", bounds("below", "a", "b")).select("series_id", "estimate", "i.lower", "i.upper")


def progress(drawn: DataFrame, batch: int, level: float = 0.95) -> DataFrame:
    """State after every ``batch`` iterations: mean and spread so far, interval from 30 on.
    A draw counts for its own batch and those after it; nothing is computed in between."""
    tail = (1 - level) / 2
    last = F.max("iteration").over(Window.partitionBy("series_id"))
    own = F.ceil(F.col("iteration") / batch) * batch
    numbered = drawn.withColumn("_last", F.floor(last / batch) * batch).withColumn("_own", own).where("_own <= _last")
    reached = numbered.withColumn("_at", F.explode(F.sequence("_own", "_last", F.lit(batch).cast("bigint"))))
    enough = F.col("_at") >= 30
    return (
        reached.groupBy("series_id", "_at")
        .agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("std"), F.percentile("b", F.lit(tail)).alias("_low"), F.percentile("b", F.lit(1 - tail)).alias("_high"))
        .select("series_id", F.col("_at").alias("iteration"), "mean", "std", F.when(enough, F.col("_low")).alias("lower"), F.when(enough, F.col("_high")).alias("upper"))
    )


def resampled(rows: DataFrame, statistic: Callable[[np.ndarray], float], iterations: int = 1000, value: str = "ret", block: int = 50) -> DataFrame:
    """(series_id, iteration, b) as ``resamples``, of any function from an array of values to
    a number. Draws are a function of iteration and position, so a resample is made where
    it is used: a task gets a series' values and ``block`` iterations, and neither draws nor
    resamples are joined or shuffled. A statistic that fails or isn't finite gives null."""
    known = rows.where(F.col(value).isNotNull()).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("x"))))["x"].alias("values"))
    blocks = known.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(iterations), F.lit(block))))
    kind = rows.schema["series_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for series, values, first in part.itertuples(index=False):
                x = np.asarray(values, float)
                numbers = range(first, min(first + block, iterations + 1))
                found = []
                for i in numbers:
                    picks = np.fromiter((int(hashlib.md5(b"%d-%d" % (i, p)).hexdigest()[:8], 16) for p in range(len(x))), np.int64, len(x)) % len(x)
                    try:
                        b = float(statistic(x[picks]))
                    except (ArithmeticError, ValueError):
                        b = None
                    found.append(b if b is not None and np.isfinite(b) else None)
                yield pd.DataFrame({"series_id": [series] * len(found), "iteration": list(numbers), "b": pd.Series(found, dtype="float64")})

    spread = blocks.repartition("series_id", "first")
    return spread.mapInPandas(run, f"series_id {kind}, iteration int, b double")
