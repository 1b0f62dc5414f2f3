"""A store of rows by time that reads no more than is asked for.

Rows are a table partitioned by a column of few values (a timeframe, a status), bucketed by
another (an instrument, a signal's series) and sorted within. A read of one partition lists
only its folder, one of some keys opens only their buckets, and what is grouped, joined or
windowed by the bucketed column needs no exchange. Nulls in the partition column have a folder
of their own and match no lookup; an empty table can be saved and gives no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, name: str, partition: str, bucket: str, time: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Write ``rows`` as table ``name`` (in ``path``, or the warehouse) and open it. Rows are
    first brought together by partition and bucket, so that each makes one file, and one that
    grows hot one file a bucket at most."""
    spread = rows.repartition(buckets, bucket)
    writer = spread.write.partitionBy(partition).bucketBy(buckets, bucket).sortBy(bucket, time)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def between(rows: DataFrame, time: str = "time", start: dt.date | dt.datetime | str | None = None, end: dt.date | dt.datetime | str | None = None, **equal: object) -> DataFrame:
    """``rows`` from ``start`` up to before ``end`` (None: no bound) where each column named in
    ``equal`` has the value given, or one of a list of them. All conditions reach the scan."""
    for column, wanted in equal.items():
        if isinstance(wanted, (list, tuple, set)):
            rows = rows.where(F.col(column).isin(*wanted))
        else:
            rows = rows.where(F.col(column) == F.lit(wanted))
    kind = rows.schema[time].dataType
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        rows = rows.where(F.col(time) < F.lit(end).cast(kind))
    return rows


def instrument(instruments: DataFrame, id: object = None, symbol: str | None = None) -> DataFrame:
    """The instrument of this ``series_id``, or of this ``symbol`` in either case; no row if
    there is none."""
    if (id is None) == (symbol is None):
        raise ValueError("give an id or a symbol")
    return instruments.where(F.col("series_id") == F.lit(id) if symbol is None else F.upper("symbol") == symbol.upper())


def bars_of(spark: SparkSession, name: str, instruments: DataFrame, symbol: str, timeframe: str, start: object = None, end: object = None) -> DataFrame:
    """Bars of one symbol and timeframe in order of time. The symbol is looked up first, as
    one row of ``instruments``, so that its bucket alone is opened."""
    found = instrument(instruments, symbol=symbol).select("series_id").first()
    rows = spark.table(name)
    if found is None:
        return rows.limit(0)
    return between(rows, start=start, end=end, timeframe=timeframe, series_id=found[0]).orderBy("time")
