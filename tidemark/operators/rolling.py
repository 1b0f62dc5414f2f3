"""Rolling rank correlations and expanding percentiles over long series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

#: Rows of a series that a task computes; it reads width - 1 more before them.
BLOCK = 65_536


def rolling_kendall(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Kendall's tau-b over the last ``width`` values; NaN before, and where one of the two
    never changes. The pairs of a window are summed by their distance: those at one
    distance are a running sum, from which a window's share is one subtraction."""
    n = len(x)
    concordant, tied_x, tied_y = (np.zeros(max(0, n - width + 1), np.int64) for _ in range(3))
    if n < width or width < 2:
        return np.full(n, np.nan)
    for gap in range(1, width):
        dx, dy = np.sign(x[gap:] - x[:-gap]).astype(np.int64), np.sign(y[gap:] - y[:-gap]).astype(np.int64)
        for total, each in ((concordant, dx * dy), (tied_x, dx == 0), (tied_y, dy == 0)):
            running = np.concatenate([[0], np.cumsum(each)])
            total += running[width - gap :] - running[: len(running) - (width - gap)]
    pairs = width * (width - 1) // 2
    both = ((pairs - tied_x) * (pairs - tied_y)).astype(float)
    tau = np.divide(concordant, np.sqrt(both), out=np.full(len(both), np.nan), where=both > 0)
    return np.concatenate([np.full(width - 1, np.nan), tau])


def rolling_spearman(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Spearman's rho (ties get mean ranks) over the last ``width`` values; NaN before, and
    where one of the two never changes. Ranks are kept, not made anew: a value that leaves
    or enters moves the rank of each other by what their order says."""
    out = np.full(len(x), np.nan)
    if len(x) < width or width < 2:
        return out
    held = np.array([x[:width], y[:width]])
    ranks = np.sign(held[:, :, None] - held[:, None]).sum(axis=2)  # twice the rank's distance from the middle
    for t in range(width - 1, len(x)):
        if t >= width:
            at, fresh = t % width, np.array([[x[t]], [y[t]]])
            ranks -= np.sign(held - held[:, at : at + 1])
            held[:, at : at + 1] = fresh
            change = np.sign(held - fresh)
            ranks += change
            ranks[:, at] = -change.sum(axis=1)
        squares = (ranks * ranks).sum(axis=1)
        if squares.all():
            out[t] = (ranks[0] * ranks[1]).sum() / np.sqrt(squares[0] * squares[1])
    return out


KINDS = {"kendall": rolling_kendall, "spearman": rolling_spearman}


def rank_correlation(rows: DataFrame, x: str, y: str, width: int, kind: str, block: int = BLOCK) -> DataFrame:
    """series_id, t and ``r``, the ``kind`` of correlation over full frames of ``width``
    rows; null before and where one of the two never changes or is missing in the frame.

    ``t`` numbers a series' rows without gaps. A series is cut into blocks of ``block`` rows
    that also read the ``width - 1`` rows before them, so none has to sit in one task."""
    if kind not in KINDS:
        raise ValueError(f"unknown correlation: {kind}")
    block = max(block, width)
    own = F.col("t").cast("bigint")
    parts = F.array_distinct(F.array(F.floor(own / block), F.floor((own + width - 1) / block)))
    placed = rows.select("series_id", own.alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(parts).alias("part"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        a, b = group["x"].to_numpy(float), group["y"].to_numpy(float)
        known = ~(np.isnan(a) | np.isnan(b))
        r = KINDS[kind](np.where(known, a, 0.0), np.where(known, b, 0.0), width)
        full = np.convolve(known, np.ones(width, int))[: len(a)] == width
        found = group.assign(r=np.where(full, r, np.nan))
        found = found[found["t"] // block == found["part"]]
        return found.assign(r=found["r"].astype(object).where(found["r"].notna(), None))[["series_id", "t", "r"]]

    kept = rows.schema["series_id"].dataType.simpleString()
    return placed.groupBy("series_id", "part").applyInPandas(run, f"series_id {kept}, t bigint, r double")


#: Cut points of a long series' values; a bucket between two holds about 1/256 of its rows.
BUCKETS = 256


def percentile_so_far(rows: DataFrame, value: str, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """series_id, t, ``value`` and ``percentile``: the share of a series' values up to and with
    this row that are no larger. Rows without a value take no part; ``t`` is unique.

    No task needs a whole series. Values no larger within a row's own block of ``block`` times
    are counted by that block's task. Of earlier blocks, those in smaller buckets of values
    come from a table of counts by block and bucket, and those in its own bucket are counted
    by that bucket's task. A value that is itself a cut point has a bucket of its own, where
    all are equal, so that a frequent value needs no task. Series of one block skip the table."""
    kept = rows.schema["series_id"].dataType.simpleString()
    own = rows.where(F.col(value).isNotNull()).select("series_id", F.col("t").cast("bigint").alias("t"), F.col(value).cast("double").alias("v"))
    placed = own.withColumn("tb", F.floor(F.col("t") / block))
    points = [i / buckets for i in range(1, buckets)]
    spans = placed.groupBy("series_id").agg(F.percentile_approx("v", points, 10_000).alias("cuts"), F.min("tb").alias("first"), F.max("tb").alias("last")).where("first < last")
    cuts = spans.select(F.col("series_id").alias("id"), F.explode(F.sequence("first", "last")).alias("tb"), F.array_sort(F.array_distinct("cuts")).alias("cuts"))

    def inside(part: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        v = part["v"].to_numpy(float)
        vb = np.full(len(part), -1)
        if len(cut):
            at = np.asarray(cut["cuts"].iloc[0], float)
            low = np.searchsorted(at, v, "left")
            vb = low * 2 + np.isin(v, at)
        return part.assign(vb=vb, inside=kernels.no_larger_before(v) + 1, place=np.arange(1, len(part) + 1))

    columns = f"series_id {kept}, t bigint, v double, tb bigint, vb bigint, inside bigint, place bigint"
    counted = placed.groupBy("series_id", "tb").cogroup(cuts.groupBy("id", "tb")).applyInPandas(inside, columns)

    def same(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        found = kernels.no_larger_before(part["v"].to_numpy(float), part["tb"].to_numpy()) if part["vb"].iloc[0] % 2 == 0 else 0
        return part.assign(same=found).drop(columns="lot")

    lot = F.when(F.col("vb") % 2 == 0, F.lit(-1)).otherwise(F.col("tb"))
    beside = counted.withColumn("lot", lot).groupBy("series_id", "vb", "lot").applyInPandas(same, f"{columns}, same bigint")
    # every cell of a long series' table, so that sums over earlier blocks know empty ones too
    cells = counted.where("vb >= 0").groupBy("series_id", "tb", "vb").agg(F.count("*").alias("n"))
    grid = cuts.select(F.col("id").alias("series_id"), "tb", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.size("cuts") * 2).cast("bigint"))).alias("vb"))
    earlier = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("series_id", "vb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = grid.join(cells, ["series_id", "tb", "vb"], "left").withColumn("earlier", earlier)
    block_of = Window.partitionBy("series_id", "tb")
    upto = F.sum("earlier").over(block_of.orderBy("vb").rowsBetween(Window.unboundedPreceding, 0))
    sums = filled.withColumns({"upto": upto, "all": F.sum("earlier").over(block_of)})
    below = sums.select("series_id", "tb", "vb", F.when(F.col("vb") % 2 == 0, F.col("upto") - F.col("earlier")).otherwise(F.col("upto")).alias("below"), "all")
    joined = beside.join(below, ["series_id", "tb", "vb"], "left")
    known = F.col("inside") + F.col("same") + F.coalesce("below", F.lit(0))
    return joined.select("series_id", "t", F.col("v").alias(value), (known / (F.col("place") + F.coalesce("all", F.lit(0)))).alias("percentile"))
