"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(spans: DataFrame, width: int) -> DataFrame:
    """``spans`` (start, end) with the first of the time bins of ``width`` seconds that each
    touches, and a row per bin. Half-open: a span without length touches none."""
    first, last = F.floor(F.unix_micros("start") / (width * 1_000_000)), F.floor((F.unix_micros("end") - 1) / (width * 1_000_000))
    real = spans.where(F.col("start") < F.col("end"))
    return real.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence("_first", last)))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """All pairs of ``a`` and ``b`` (``keys``, start, end; other names must differ) of equal
    keys that overlap, with the overlap as ``start`` and ``end``. Half-open intervals.

    An equi-join by key and time bin, so that a hot key is spread by its bins, and the exact
    test after it; of the bins that a pair shares only the first reports it. ``width`` should
    be about as long as usual spans: longer ones take a row per bin."""
    left = binned(a, width).withColumnsRenamed({"start": "_a", "end": "_b", "_first": "_f"})
    right = binned(b, width).withColumnsRenamed({"start": "_c", "end": "_d", "_first": "_g"})
    met = left.join(right, [*keys, "_bin"]).where((F.col("_a") < F.col("_d")) & (F.col("_c") < F.col("_b")) & (F.col("_bin") == F.greatest("_f", "_g")))
    return met.withColumns({"start": F.greatest("_a", "_c"), "end": F.least("_b", "_d")}).drop("_a", "_b", "_c", "_d", "_f", "_g", "_bin")
