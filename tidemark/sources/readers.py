"""Providers' files as bars (time, open, high, low, close, volume).

Schemas are given, never inferred. A registry maps a provider's name to its reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ("time", "open", "high", "low", "close", "volume")


def plain_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="time date, open double, high double, low double, close double, volume long")


def yahoo_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns Date, Open, High, Low, Close, Adj Close, Volume."""
    raw = spark.read.csv(path, header=True, schema="Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume long")
    return raw.toDF("time", "open", "high", "low", "close", "adjusted_close", "volume")


def alpha_vantage_json(spark: SparkSession, path: str) -> DataFrame:
    """A map from date to fields under "Time Series (Daily)"."""
    fields = "struct<`1. open`:string,`2. high`:string,`3. low`:string,`4. close`:string,`5. volume`:string>"
    text = spark.read.text(path, wholetext=True)
    days = text.select(F.explode(F.from_json("value", f"struct<`Time Series (Daily)`:map<string,{fields}>>")["Time Series (Daily)"]).alias("day", "f"))
    return days.select(
        F.to_date("day").alias("time"), *[F.col(f"f.`{i}. {n}`").cast("double").alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"))], F.col("f.`5. volume`").cast("long").alias("volume")
    )


def polygon_json(spark: SparkSession, path: str) -> DataFrame:
    """``results`` of t (epoch ms), o, h, l, c, v."""
    raw = spark.read.schema("results array<struct<t:long,o:double,h:double,l:double,c:double,v:double>>").json(path, multiLine=True)
    rows = raw.select(F.explode("results").alias("r"))
    return rows.select(F.timestamp_millis("r.t").alias("time"), *[F.col(f"r.{x}").alias(n) for x, n in zip("ohlc", BAR[1:5], strict=True)], F.col("r.v").cast("long").alias("volume"))


def positioning_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="series_id string, time date, commercial_long long, commercial_short long, price double, nav double, volume long, aum double")


def market_xml(spark: SparkSession, path: str) -> DataFrame:
    """One <bar> element per line."""
    raw = spark.read.text(path)
    return raw.select(F.from_xml("value", "time date, open double, high double, low double, close double, volume long").alias("b")).select("b.*")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": plain_csv, "yahoo": yahoo_csv, "alphavantage": alpha_vantage_json, "polygon": polygon_json, "cot": positioning_csv, "xml": market_xml,
}


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in READERS:
        raise ValueError(f"unknown source: {source}")
    return READERS[source](spark, path)


def first_working(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """The first of (source, path) whose schema and a first row can be read."""
    errors = []
    for source, path in sources:
        try:
            found = read(spark, source, path)
            found.head(1)
            return found
        except Exception as error:  # whatever the provider's file is like, the next is tried
            errors.append(f"{source}: {type(error).__name__}")
    raise OSError("no source works: " + "; ".join(errors))


def prioritized(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources, per key that of the first source that has it."""
    marked = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    every = marked[0]
    for more in marked[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_priority")
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_priority")


def synthetic(spark: SparkSession, days: int, base: float = 100.0, growth: float = 0.08, volatility: float = 0.01, cycles: dict[int, float] | None = None, seed: int = 1, start: str = "2010-01-01") -> DataFrame:
    """Daily bars of trend, cycles, a yearly wave and noise, floored at a tenth of base."""
    t = F.col("id")
    wave = F.lit(0.0)
    for period, amplitude in (cycles or {14: 1.0, 42: 2.0, 98: 3.0}).items():
        wave = wave + amplitude * F.sin(2 * F.pi() * t / period)
    year = 0.02 * base * F.sin(2 * F.pi() * t / 365 - F.pi() / 4)
    close = F.greatest(F.lit(0.1 * base), base * F.exp(F.log1p(F.lit(growth)) / 252 * t) + wave + year + F.randn(seed) * volatility * base)
    rows = spark.range(days).select(t.alias("t"), F.date_add(F.to_date(F.lit(start)), t.cast("int")).alias("time"), close.alias("close"), (F.rand(seed + 1) - 0.5).alias("_o"), F.rand(seed + 2).alias("_h"), F.rand(seed + 3).alias("_l"), F.randn(seed + 4).alias("_v"))
    opened = rows.withColumn("open", F.col("close") * (1 + F.col("_o") * volatility))
    high = F.greatest("open", "close") * (1 + F.col("_h") * volatility)
    low = F.least("open", "close") * (1 - F.col("_l") * volatility)
    return opened.select("time", "open", high.alias("high"), low.alias("low"), "close", (F.exp(F.col("_v") * 0.3) * 1e6).cast("long").alias("volume"), "t")


def write_csv(bars: DataFrame, path: str) -> None:
    bars.write.csv(path, header=True)


def write_partitioned(bars: DataFrame, path: str) -> None:
    """Parquet by timeframe and instrument, so that range scans prune folders."""
    bars.write.partitionBy("timeframe", "series_id").parquet(path)
