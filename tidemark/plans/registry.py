"""How a query and its SQL twin are registered, and the relations that both start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PRICE = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
RELATIONS = {
    "daily": f"""
daily0 AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS time, arg_min(l_extendedprice, {_PRICE}) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, {_PRICE}) AS close, count(*) AS volume
  FROM lineitem GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS t FROM daily0)""",
    "weekly": """
weekly0 AS (
  SELECT c_mktsegment AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS time, arg_min(o_totalprice, row(o_orderkey, o_totalprice)) AS open,
    max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderkey, o_totalprice)) AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
weekly AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS t FROM weekly0)""",
    "hourly": """
hourly0 AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS time, arg_min(value, row(event_id, value)) AS open,
    max(value) AS high, min(value) AS low, arg_max(value, row(event_id, value)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2),
hourly AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS t FROM hourly0)""",
    "reports": """
reports0 AS (
  SELECT r_name AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS time, avg(l_extendedprice / nullif(l_quantity, 0)) AS price,
    avg(p_retailprice) AS nav, sum(l_quantity) AS volume, sum(s_acctbal) AS aum, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END) AS net
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
reports AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS t FROM reports0)""",
    "rets": """
rets AS (
  SELECT *, close - lag(close) OVER w AS diff, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
    CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS logret
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY t))""",
    "vols": """
vols AS (
  SELECT *, CASE WHEN t >= 21 AND count(logret) OVER w >= 10 THEN stddev_pop(logret) OVER w * sqrt(252.0) END AS vol
  FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS 20 PRECEDING))""",
    "flat": """
lined AS (
  SELECT *, coalesce(regr_intercept(close, t) OVER w + regr_slope(close, t) OVER w * t, avg(close) OVER w) AS trend FROM bars
  WINDOW w AS (PARTITION BY series_id)),
flat AS (
  SELECT *, close - trend AS detrended,
    (close - trend - avg(close - trend) OVER (PARTITION BY series_id)) / stddev_pop(close - trend) OVER (PARTITION BY series_id) AS x FROM lined)""",
}

#: Decimal places that doubles are compared at.
PLACES = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, dates and times as text."""
    out = []
    for field in df.schema.fields:
        x, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = F.round(x.cast("double"), PLACES) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            x = x.cast("bigint")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            x = x.cast("string")
        out.append(x.alias(field.name))
    return df.select(out)


def twin(relations: str, body: str, columns: str) -> str:
    """DuckDB SQL: ``columns`` lists names with a letter each: d double, i whole number,
    t date or time, s text, b boolean; further relations may precede the body."""
    cast = {"d": f"round(CAST({{0}} AS DOUBLE), {PLACES}) + 0.0", "i": "CAST({0} AS BIGINT)", "t": "CAST({0} AS VARCHAR)", "s": "{0}", "b": "{0}"}
    names = [c.split(":") for c in columns.split()]
    chosen = ", ".join(f"{cast[k].format(f'"{n}"')} AS \"{n}\"" for n, k in names)
    given = [RELATIONS[r].strip() for r in relations.split()]
    return f"WITH {', '.join([*given, f'answer AS ({body})'])}\nSELECT {chosen} FROM answer"


def register(name: str, run: Query, relations: str = "", body: str = "", columns: str = "") -> None:
    """A query, and its twin unless ``body`` is empty (then tests cover it)."""
    QUERIES[name] = lambda spark, sf_dir: tidy(run(spark, sf_dir))
    if body:
        ORACLES[name] = twin(relations, body, columns)
