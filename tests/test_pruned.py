"""Reads of a stored table touch only the folders and buckets that they need."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.sources import pruned


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    hours = spark.range(4000).select(F.concat(F.lit("i"), F.col("id") % 20).alias("series_id"), F.when(F.col("id") % 2 == 0, "1d").otherwise("1h").alias("timeframe"), F.timestamp_seconds(F.col("id") * 3600).alias("time"), F.col("id").cast("double").alias("close"))
    yield hours, pruned.save(hours, "pruned_bars", "timeframe", "series_id", "time", 8, str(tmp_path_factory.mktemp("pruned") / "bars"))
    spark.sql("DROP TABLE pruned_bars")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reads_equal_plain_filters(spark, stored):
    rows, table = stored
    lo, hi = dt.datetime(1970, 1, 10), dt.datetime(1970, 3, 1)
    for ids in ("i4", ["i4", "i7", "none"]):
        got = pruned.between(table, start=lo, end=hi, timeframe="1d", series_id=ids).select(*rows.columns)
        wanted = [ids] if isinstance(ids, str) else ids
        want = rows.where((F.col("timeframe") == "1d") & F.col("series_id").isin(wanted) & (F.col("time") >= lo) & (F.col("time") < hi))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    assert pruned.between(table).count() == 4000
    empty = pruned.save(rows.limit(0), "pruned_none", "timeframe", "series_id", "time", 4)
    assert empty.count() == 0
    spark.sql("DROP TABLE pruned_none")


def test_folders_and_buckets_are_pruned(stored):
    _, table = stored
    text = plan(pruned.between(table, start="1970-02-01", timeframe="1d", series_id="i4"))
    assert "PartitionFilters: [isnotnull(timeframe" in text and "PushedFilters: [IsNotNull(series_id)" in text and "GreaterThanOrEqual(time" in text
    files = pruned.between(table, timeframe="1d", series_id="i4").select(F.input_file_name()).distinct().collect()
    assert len(files) == 1 and "timeframe=1d" in files[0][0]


def test_a_window_by_series_needs_no_exchange(stored):
    _, table = stored
    last = F.lag("close").over(Window.partitionBy("series_id").orderBy("time"))
    one = table.where("timeframe = '1d'").select("series_id", "time", last.alias("before"))
    assert "Exchange" not in plan(one)
    assert "Exchange" not in plan(table.where("timeframe = '1h'").groupBy("series_id").agg(F.avg("close")))


def test_lookups(spark, stored):
    instruments = spark.createDataFrame([("i4", "ABC", "x"), ("i5", "DEF", "y"), (None, None, "z")], "series_id string, symbol string, name string")
    assert [r["name"] for r in pruned.instrument(instruments, id="i5").collect()] == ["y"]
    assert [r["name"] for r in pruned.instrument(instruments, symbol="abc").collect()] == ["x"]
    assert pruned.instrument(instruments, id="no").count() == 0
    with pytest.raises(ValueError, match="an id or a symbol"):
        pruned.instrument(instruments)
    times = [r["time"] for r in pruned.bars_of(spark, "pruned_bars", instruments, "abc", "1d").collect()]
    assert times == sorted(times) and len(times) == 200
    assert pruned.bars_of(spark, "pruned_bars", instruments, "zzz", "1d").count() == 0
