"""Sketches of short spans that are kept and merged for longer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count; three standard errors of it.
REGISTERS = 12
ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)
#: Size of a quantile sketch, and the error of a rank by it at 99 %.
SIZE = 200
RANK_ERROR = 0.0165


def daily(rows: DataFrame, by: list[str], time: str, distinct: str, value: str) -> DataFrame:
    """Per ``by`` and day: number of rows, a sketch of the distinct ``distinct`` and one of
    the quantiles of ``value``. Small rows to be kept; ``merged`` unites them."""
    return rows.groupBy(*by, F.to_date(time).alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, REGISTERS).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SIZE)).alias("quantiles"))


def merged(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """The sketches of all days of ``by`` as one each, without a row of what they stand for."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def read(sketches: DataFrame, *shares: float) -> DataFrame:
    """The distinct count and the values at ``shares``."""
    at = [F.kll_sketch_get_quantile_double("quantiles", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares]
    return sketches.withColumn("distinct_count", F.hll_sketch_estimate("distinct")).select("*", *at).drop("distinct", "quantiles")
