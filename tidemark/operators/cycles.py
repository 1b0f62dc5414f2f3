"""Cycles: lagged correlation, stability, energy, maximum entropy, composite lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import by_time, divided


def _lagged(rows: DataFrame, low: int, high: int) -> DataFrame:
    """x at t and x at t - period, for every period from ``low`` to ``high``.

    The rows are exploded by period and joined on (series, t): an equi join, whose keys
    spread a series over all tasks.
    """
    periods = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("period")
    late = rows.select("series_id", F.col("t").cast("long").alias("t"), F.col("x").alias("x1"), periods)
    early = rows.select("series_id", F.col("t").cast("long").alias("_t0"), F.col("x").alias("x0"))
    return late.withColumn("_t0", F.col("t") - F.col("period")).where("_t0 >= 0").join(early, ["series_id", "_t0"]).drop("_t0")


def correlations(rows: DataFrame, low: int, high: int, parts: int = 5) -> DataFrame:
    """Per series and period up to a third of its length: correlation (mean lagged
    product), stability (share of ``parts`` equal blocks where it is positive; 0.5 where a
    block is shorter than two periods), energy, and amplitude and phase of the sinusoid."""
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    pairs = _lagged(rows, low, high)
    size = F.floor(F.col("n") / parts)
    joined = pairs.join(sizes, "series_id").where(F.col("period") <= F.floor(F.col("n") / 3))
    block = F.floor(F.col("t") / F.nullif(size, F.lit(0)))
    inside = (block == F.floor((F.col("t") - F.col("period")) / F.nullif(size, F.lit(0)))) & (block < parts)
    product = F.col("x1") * F.col("x0")
    by_block = joined.groupBy("series_id", "period", "n", F.when(inside, block).alias("block")).agg(F.sum(product).alias("s"))
    stable = F.count_if(F.col("block").isNotNull() & (F.col("s") > 0)) / parts
    found = by_block.groupBy("series_id", "period", "n").agg(F.sum("s").alias("s"), stable.alias("stable"))
    found = found.withColumn("correlation", F.col("s") / (F.col("n") - F.col("period")))
    found = found.withColumn("stability", F.when(size >= 2 * F.col("period"), F.col("stable")).otherwise(F.lit(0.5)))
    found = found.withColumn("energy", F.abs("correlation") * F.sqrt(F.col("n") / F.col("period")) * F.col("stability"))
    return found.select("series_id", "period", "n", "correlation", "stability", "energy")


def fourier(rows: DataFrame, low: int, high: int) -> DataFrame:
    """amplitude and phase of each period: x is nearly A cos(2 pi t / period - phase)."""
    wide = rows.select("series_id", "t", "x", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("period"))
    angle = F.lit(2 * math.pi) * F.col("t") / F.col("period")
    sums = wide.groupBy("series_id", "period").agg((2 * F.sum(F.col("x") * F.cos(angle)) / F.count("*")).alias("a"), (2 * F.sum(F.col("x") * F.sin(angle)) / F.count("*")).alias("b"))
    phase = F.pmod(F.atan2("b", "a"), F.lit(2 * math.pi))
    return sums.select("series_id", "period", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("amplitude"), phase.alias("phase"))


def dominant(found: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` periods by energy, ties to the shorter, with ``rank`` from 1."""
    order = Window.partitionBy("series_id").orderBy(F.desc("energy"), "period")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def slots(top3: DataFrame) -> DataFrame:
    """The three dominant periods of a series by length: short, medium, long."""
    order = Window.partitionBy("series_id").orderBy("period")
    named = top3.withColumn("slot", F.element_at(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), F.row_number().over(order)))
    return named


def composite(cycles: DataFrame, length: int, start: int = 0) -> DataFrame:
    """Sum of the cycles' sinusoids at t = start..start+length-1, scaled to 1, with its
    slope's sign and whether all waves rise (BUY) or fall (SELL) at once."""
    return _summed(cycles.select("series_id", "period", "amplitude", "phase", F.explode(F.sequence(F.lit(start), F.lit(start + length - 1))).alias("t")))


def projected(cycles: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """``composite`` over the ``days`` steps after the end of each series, with the calendar
    date of each (``time``: the last bar's, and so many days on). Cycles of series without
    bars have no row."""
    last = bars.groupBy("series_id").agg((F.max("t") + 1).alias("_first"), F.to_date(F.max("time")).alias("_last"))
    steps = F.sequence(F.col("_first"), F.col("_first") + (days - 1))
    points = cycles.join(last, "series_id").select("series_id", "period", "amplitude", "phase", F.explode(steps).alias("t"))
    ahead = _summed(points).join(last, "series_id")
    return ahead.withColumn("time", F.date_add("_last", (F.col("t") - F.col("_first") + 1).cast("int"))).drop("_first", "_last")


def _summed(points: DataFrame) -> DataFrame:
    turn = F.lit(2 * math.pi) / F.col("period")
    angle = turn * F.col("t") - F.col("phase")
    waves = points.select("series_id", "t", (F.col("amplitude") * F.cos(angle)).alias("y"), (-F.col("amplitude") * turn * F.sin(angle)).alias("dy"))
    line = waves.groupBy("series_id", "t").agg(
        F.sum("y").alias("y"), F.sum("dy").alias("dy"), F.bool_and(F.col("dy") > 0).alias("up"), F.bool_and(F.col("dy") < 0).alias("down"), F.count("*").alias("waves")
    )
    scaled = divided(F.col("y"), F.max(F.abs("y")).over(Window.partitionBy("series_id")))
    signal = F.when(F.col("up"), "BUY").when(F.col("down"), "SELL").otherwise("NONE")
    return line.select("series_id", "t", scaled.alias("value"), F.signum("dy").cast("long").alias("direction"), signal.alias("resonance"))


def turns(line: DataFrame) -> DataFrame:
    """Local extrema of a composite line."""
    x, before, after = F.col("value"), F.lag("value").over(by_time()), F.lead("value").over(by_time())
    kind = F.when((x < before) & (x < after), "BOTTOM").when((x > before) & (x > after), "TOP")
    return line.select("series_id", "t", "value", kind.alias("kind")).where("kind IS NOT NULL")


PSD = "series_id string, frequency double, power double"


def entropy_spectrum(rows: DataFrame, order: int = 20, value: str = "x") -> DataFrame:
    """Power by frequency of a maximum-entropy (Burg) model of each series."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("t")[value].to_numpy(float)
        if len(x) < 3:
            return pd.DataFrame({"series_id": [], "frequency": [], "power": []})
        a, _, noise = kernels.burg(x, min(order, len(x) // 2))
        frequency, power = kernels.spectrum(a, max(noise, 1e-300), len(x) // 2 + 1)
        return pd.DataFrame({"series_id": part["series_id"].iloc[0], "frequency": frequency, "power": power})

    return rows.where(F.col(value).isNotNull()).select("series_id", "t", value).groupBy("series_id").applyInPandas(kernel, PSD)


def reflection(rows: DataFrame) -> DataFrame:
    """First reflection coefficient of Burg's method, in closed form."""
    before = F.lag("x").over(by_time())
    parts = rows.select("series_id", (F.col("x") * before).alias("xy"), (F.col("x") * F.col("x") + before * before).alias("xx"))
    k = divided(-2 * F.sum("xy"), F.sum("xx"))
    return parts.groupBy("series_id").agg(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), k)).alias("k1"))


def spectral_entropy(psd: DataFrame) -> DataFrame:
    """Shannon entropy of the power shares over the log of their number."""
    total = F.sum("power").over(Window.partitionBy("series_id"))
    shares = psd.withColumn("p", divided(F.col("power"), total))
    return shares.groupBy("series_id").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10)) / F.ln(F.nullif(F.count("*"), F.lit(1)))).alias("entropy"))


def analysis(rows: DataFrame, low: int = 5, high: int = 100, top: int = 3, order: int = 20) -> DataFrame:
    """One row per series: its cycles, entropy, messages and whether it is valid. ``rows``
    (series_id, t, x) is read several times; keep it in a table or cache."""
    cycles = dominant(correlations(rows, low, high), top).join(fourier(rows, low, high), ["series_id", "period"])
    listed = cycles.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "period", "energy", "stability", "correlation", "amplitude", "phase"))).alias("cycles"), F.max("energy").alias("energy")
    )
    entropy = spectral_entropy(entropy_spectrum(rows, order))
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    joined = sizes.join(listed, "series_id", "left").join(entropy, "series_id", "left")
    messages = F.array_compact(
        F.array(
            F.when(F.col("n") < 50, F.lit("too few points")),
            F.when(F.col("energy") < 0.1, F.lit("low energy")),
            F.when(F.col("entropy") > 0.9, F.lit("spectrum is noise")),
        )
    )
    return joined.withColumn("message", F.array_join(messages, "; ")).withColumn("valid", (F.col("message") == "") & F.col("cycles").isNotNull())


def significance(rows: DataFrame, period: int, surrogates: int = 100, threshold: float = 0.05, seed: int = 7) -> DataFrame:
    """Share of phase-randomized surrogates whose lagged correlation at ``period`` is at
    least the series' own; surrogates of a series are spread over tasks."""
    packed = rows.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda v: v["x"]).alias("x"))
    asked = packed.select("series_id", "x", F.explode(F.sequence(F.lit(0), F.lit(surrogates))).alias("i")).repartition("series_id", "i")

    def run(batches):
        for part in batches:
            out = []
            for series, x, i in zip(part["series_id"], part["x"], part["i"], strict=True):
                x = np.asarray(x, float)
                y = kernels.surrogate(x, seed + int(i)) if i else x
                out.append((series, int(i), float(abs((y[period:] * y[:-period]).mean())) if len(x) > period else 0.0))
            yield pd.DataFrame(out, columns=["series_id", "i", "c"])

    found = asked.mapInPandas(run, "series_id string, i int, c double")
    own = F.max(F.when(F.col("i") == 0, F.col("c"))).over(Window.partitionBy("series_id"))
    compared = found.withColumn("own", own)
    p = F.avg(F.when(F.col("i") > 0, (F.col("c") >= F.col("own")).cast("double")))
    return compared.groupBy("series_id").agg(p.alias("p_value")).withColumn("significant", F.col("p_value") < threshold)
