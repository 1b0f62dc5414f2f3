"""Historical analogies by dynamic time warping: filter cheaply, then warp the survivors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import clip, correlation, divided
from . import windows


def _against(history: DataFrame, target: DataFrame, length: int) -> DataFrame:
    """Every window's rows beside the target's at the same position. The target is one map
    of at most ``length`` numbers, so no join has positions as its few keys."""
    spots = target.where(F.col("t").between(0, length - 1)).agg(F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("_target"))
    cut = windows.sliding(history, length, max(1, length // 2)).withColumn("k", (F.col("t") - F.col("start")).cast("long"))
    beside = cut.join(F.broadcast(spots))
    return beside.where(F.map_contains_key("_target", F.col("k"))).withColumn("target_x", F.element_at("_target", F.col("k"))).drop("_target")


def candidates(history: DataFrame, target: DataFrame, length: int, least: float = 0.6, most: int = 100) -> DataFrame:
    """Windows of ``length`` rows at half-window steps whose correlation with ``target``
    (t, x; t from 0, once each) is at least ``least``; of each series the ``most`` best."""
    r = _against(history, target, length).groupBy("series_id", "start").agg(correlation(F.col("x"), F.col("target_x")).alias("r"), F.count("*").alias("n"))
    order = Window.partitionBy("series_id").orderBy(F.desc("r"), "start")
    return r.where((F.col("r") >= least) & (F.col("n") == length)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def _unit(x: np.ndarray) -> np.ndarray:
    spread = x.std()
    return (x - x.mean()) / spread if spread > 1e-10 else np.zeros(len(x))


def matched(history: DataFrame, target: DataFrame, length: int, band: int = 10, horizon: int = 10, least: float = 0.6, most: int = 100) -> DataFrame:
    """Candidates with their warping distance, confidence, rank and the continuation after
    the match, rescaled to the target's level and spread. One task unit is a window."""
    kept = candidates(history, target, length, least, most)
    spans = kept.select("series_id", "start", "r", F.explode(F.sequence(F.col("start"), F.col("start") + length + horizon - 1)).alias("t"))
    values = spans.join(history.select("series_id", "t", "x"), ["series_id", "t"])
    packed = values.groupBy("series_id", "start", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda v: v["x"]).alias("x"))
    goal = target.agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda v: v["x"]).alias("target"))
    both = packed.join(F.broadcast(goal))  # one row of `length` numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for series, start, r, x, y in part[["series_id", "start", "r", "x", "target"]].itertuples(index=False):
                x, y = np.asarray(x, float), np.asarray(y, float)
                window, after = x[:length], x[length:]
                distance, _ = kernels.dtw(_unit(window), _unit(y), band)
                spread = window.std() or 1.0
                out.append((series, int(start), float(r), distance, (y[-1] + (after - window[-1]) / spread * y.std()).tolist()))
            yield pd.DataFrame(out, columns=["series_id", "start", "r", "distance", "projection"])

    found = both.mapInPandas(run, "series_id string, start long, r double, distance double, projection array<double>")
    confidence = clip((F.col("r") + 1) / 2 * (1 - F.col("distance") / 100), 0.0, 1.0)
    order = Window.partitionBy("series_id").orderBy("distance", "start")
    return found.withColumns({"confidence": confidence, "rank": F.row_number().over(order)}).withColumn("is_valid", F.col("confidence") > 0.3)


def projected(matches: DataFrame, top: int = 10) -> DataFrame:
    """Mean continuation of the ``top`` nearest matches, step by step."""
    steps = matches.where(F.col("rank") <= top).select("series_id", F.posexplode("projection").alias("step", "value"))
    return steps.groupBy("series_id", "step").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("spread"), F.count("*").alias("matches"))


def quality(matches: DataFrame, least: float = 0.6) -> DataFrame:
    """Per series: the best match's figures and what is wrong with them."""
    best = F.min_by(F.struct("r", "confidence", "distance"), F.struct("distance", "start"))
    found = matches.groupBy("series_id").agg(best.alias("b"), F.avg(F.when(F.col("rank") <= 10, F.col("r"))).alias("avg_r"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("b.r") < least, F.lit("low correlation")),
            F.when(F.col("b.confidence") < 0.3, F.lit("low confidence")),
            F.when(F.col("b.distance") > 100, F.lit("large distance")),
            F.when(F.col("avg_r") < 0.8 * least, F.lit("low average")),
        )
    )
    return found.select("series_id", "b.*", "avg_r", F.array_join(issues, "; ").alias("issues"))


def euclidean(history: DataFrame, target: DataFrame, length: int) -> DataFrame:
    """Plain distance of every window from ``target``."""
    gap = F.col("x") - F.col("target_x")
    rows = _against(history, target, length)
    return rows.groupBy("series_id", "start").agg(F.sqrt(F.sum(gap * gap)).alias("distance"), divided(F.sum(F.abs(gap)), F.count("*").cast("double")).alias("mean_gap"))


def training(history: DataFrame, digit: int | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """``history`` (time) of years that end in ``digit``, from ``since`` to ``until``."""
    year, kept = F.year("time"), history
    for condition in (digit is not None and F.pmod(year, F.lit(10)) == digit, since is not None and year >= since, until is not None and year <= until):
        kept = kept if condition is False else kept.where(condition)
    return kept


def comparable(windows_: DataFrame, length: int, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """Windows (n rows each) whose length is within these multiples of the target's."""
    return windows_.where(F.col("n").between(least * length, most * length))
