"""Expanding percentiles by blocks, hash trees, a provider's folder, and signals that expire."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import lineage, rolling
from tidemark.sources import provider
from tidemark.streaming import signals


def test_kernel_counts_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 64, 100):
        for distinct in (1, 2, 1000):
            x, part = rng.integers(distinct, size=n).astype(float), np.sort(rng.integers(5, size=n))
            assert list(kernels.no_larger_before(x)) == [sum(x[j] <= x[i] for j in range(i)) for i in range(n)]
            assert list(kernels.no_larger_before(x, part)) == [sum(x[j] <= x[i] and part[j] < part[i] for j in range(n)) for i in range(n)]


@pytest.mark.parametrize("block,buckets", [(10_000, 256), (16, 4), (7, 64)])
def test_percentiles_so_far(spark, block, buckets):
    rng = np.random.default_rng(2)
    rows = []
    for name, n, distinct in (("ties", 90, 3), ("flat", 50, 1), ("wide", 150, 10**6), ("one", 1, 5), ("hot", 120, 40)):
        x = rng.integers(distinct, size=n).astype(float)
        if name == "hot":
            x[rng.random(n) < 0.5] = 7.0
        rows += [(name, t + 40 * (t > 60), None if t == 30 else float(v), "extra") for t, v in enumerate(x)]  # a gap longer than a block
    frame = spark.createDataFrame(rows, "series_id string, t int, x double, tb string")
    got = {(r["series_id"], r["t"]): r["percentile"] for r in rolling.percentile_so_far(frame, "x", block, buckets).collect()}
    want = {}
    for name in {r[0] for r in rows}:
        held = []
        for _, t, v, _ in [r for r in rows if r[0] == name]:
            if v is not None:
                held.append(v)
                want[name, t] = sum(h <= v for h in held) / len(held)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert rolling.percentile_so_far(frame.limit(0), "x", block).count() == 0


def test_long_series_is_spread(spark):
    frame = spark.range(20_000).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.sin(F.col("id") * 7.0)).alias("x"))
    cut, whole = (rolling.percentile_so_far(frame, "x", b).orderBy("t").toPandas()["percentile"] for b in (1000, 10**6))
    assert np.allclose(cut, whole) and len(cut) == 20_000


def test_trees_locate_changes(spark, tmp_path):
    old = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise("b").alias("b")).where("k <> 777")
    new = old.where("k <> 4000").withColumn("b", F.when(F.col("k") == 1234, "").otherwise(F.col("b"))).union(spark.createDataFrame([(777, "0", "b"), (90_000, "0", "b")], "k long, a string, b string"))
    for name, x in (("tree_old", old), ("tree_new", new)):
        lineage.tree(x, "k", ["a", "b"], "v1", 64, 40, 3).write.parquet(str(tmp_path / name))
    trees = [spark.read.parquet(str(tmp_path / x)) for x in ("tree_old", "tree_new")]
    assert trees[0].where("level = 2").agg(F.sum("n")).first()[0] == 4999
    assert lineage.damaged(trees[0]).count() == 0
    assert lineage.damaged(trees[0].withColumn("n", F.col("n") + F.when(F.col("node") == 3, 1).otherwise(0))).where("error = 'LN003'").count() >= 1
    ranges = lineage.changed_ranges(*trees, 40, 3)
    assert {r["node"] for r in ranges.collect()} == {777 // 64, 1234 // 64, 4000 // 64, 90_000 // 64}
    want = {(777, "added"), (1234, "changed"), (4000, "removed"), (90_000, "added")}
    assert {tuple(r) for r in lineage.changed_rows(old, new, ranges, "k", ["a", "b"], 64).collect()} == want
    assert lineage.changed_ranges(trees[0], lineage.tree(old.repartition(7), "k", ["a", "b"], "v1", 64, 40, 3), 40, 3).count() == 0
    assert lineage.tree(old.limit(0), "k", ["a"], "v1").count() == 0
    for name, x in (("old", old), ("new", new)):
        x.withColumn("leaf", F.floor(F.col("k") / 64)).repartition(2, "leaf").write.partitionBy("leaf").parquet(str(tmp_path / name))
    stored = [spark.read.parquet(str(tmp_path / x)) for x in ("old", "new")]
    ranges.write.parquet(str(tmp_path / "ranges"))
    named = lineage.changed_rows(*stored, spark.read.parquet(str(tmp_path / "ranges")), "k", ["a", "b"], 64, "leaf")
    assert {tuple(r) for r in named.collect()} == want


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(0, 240, 1, 2).select(F.timestamp_seconds(F.col("id") * 7200).alias("time"), *[(F.col("id") * i).cast("double").alias(x) for i, x in enumerate(("open", "high", "low", "close"), 1)], F.when(F.col("id") % 9 != 0, F.col("id")).alias("volume"), F.concat(F.lit("s/"), F.col("id") % 3).alias("series_id"))
    bars = rows.withColumn("day", F.to_date("time"))
    path = str(tmp_path / "given")
    bars.write.partitionBy("day", "series_id").csv(path, header=True, emptyValue="")
    provider.register(spark)
    return bars, path


def test_provider_in_batch(spark, folder, same):
    bars, path = folder
    columns = bars.columns
    read = spark.read.format("provider").load(path)
    same(read.select(*columns).toPandas(), bars.toPandas())
    asked = (F.col("series_id") == "s/1") & (F.col("day") >= dt.date(1970, 1, 9)) & (F.col("close") > 500)
    found = read.where(asked)
    same(found.select(*columns).toPandas(), bars.where(asked).toPandas())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (series_id" not in plan and plan.count("series_id = s/1") <= 1 and "close" in plan
    reader = provider.ProviderReader(path, 1)
    left = list(reader.pushFilters([provider.EqualTo(("series_id",), "s/1"), provider.GreaterThan(("close",), 900.0), provider.LessThan(("day",), dt.date(1970, 1, 3))]))
    assert [type(x) for x in left] == [provider.GreaterThan]
    assert [x[1:] for p in reader.partitions() for x in p.value] == [(dt.date(1970, 1, 1), "s/1"), (dt.date(1970, 1, 2), "s/1")]
    assert spark.read.format("provider").load(path + "_none").count() == 0


def test_provider_as_a_stream(spark, folder, same, tmp_path):
    bars, path = folder
    moving = str(tmp_path / "moving")
    for name, asked in (("given", "day < '1970-01-06'"), ("more", "day >= '1970-01-06'")):
        bars.where(asked).write.mode("append").partitionBy("day", "series_id").csv(moving, header=True, emptyValue="")
        stream = spark.readStream.format("provider").load(moving)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), name
    same(spark.read.parquet(str(tmp_path / "out")).select(*bars.columns).toPandas(), bars.toPandas())


def test_signals_expire_as_in_a_batch(spark, tmp_path, same):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 6}" if i % 50 else None, start + dt.timedelta(days=int(d), seconds=i), float(i % 4) if i % 9 else None) for i, d in enumerate(sorted(rng.integers(0, 900, 120).tolist()))]
    rows += [("s1", start + dt.timedelta(days=42), 1.0), ("edge", start, 2.0), ("edge", start + dt.timedelta(days=42), 3.0), ("end", start + dt.timedelta(days=2000), 0.0)]
    schema = "signal_id string, time timestamp, strength double"
    frame = spark.createDataFrame(rows, schema)
    parts = [rows[i : i + 31] for i in range(0, len(rows) - 4, 31)] + [rows[-4:]]
    # a row that comes a batch later than its place, within the watermark's delay
    parts[1].append(parts[0].pop(-1))
    folder = tmp_path / "signals"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / str(i)))
        stream = spark.readStream.schema(schema).parquet(str(folder / "*"))
        query = signals.expiring(stream, late="1000 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    want = signals.spans(frame)
    closed = want.where(F.col("expired") <= F.lit(start + dt.timedelta(days=1000)))
    same(spark.read.parquet(str(tmp_path / "out")).toPandas(), closed.toPandas())
    assert want.where("signal_id = 'edge'").count() == 2 and want.where("signal_id IS NULL").count() == 0
