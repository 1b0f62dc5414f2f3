"""Rolling rank correlations, interval joins, sketches, variants and a user's statistic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, intervals, normalize, rolling, sketches, variants


def plain_kendall(x, y):
    s = a = b = 0
    for i in range(len(x)):
        for j in range(i):
            dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, a, b = s + dx * dy, a + dx * dx, b + dy * dy
    return s / math.sqrt(a * b) if a * b else None


def plain_spearman(x, y):
    def ranks(v):
        return np.array([(sum(w < a for w in v) + sum(w <= a for w in v)) / 2 for a in v])

    a, b = ranks(x) - ranks(x).mean(), ranks(y) - ranks(y).mean()
    return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()) if a.any() and b.any() else None


@pytest.mark.parametrize("kind,plain", [("kendall", plain_kendall), ("spearman", plain_spearman)])
@pytest.mark.parametrize("block", [12, 1000])
def test_rolling_ranks_by_brute_force(spark, kind, plain, block):
    rng = np.random.default_rng(1)
    rows, width = [], 12
    for name, n, values in (("ties", 80, 4), ("few", 5, 9), ("flat", 40, 1), ("wide", 150, 10**6)):
        x, y = rng.integers(values, size=n).astype(float), rng.integers(values, size=n).astype(float)
        rows += [(name, t, None if name == "wide" and t == 60 else float(a), float(b), 0) for t, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "series_id string, t int, x double, y double, part int")
    got = {(r["series_id"], r["t"]): r["r"] for r in rolling.rank_correlation(frame, "x", "y", width, kind, block).collect()}
    assert len(got) == len(rows)
    by_series = {}
    for name, _, x, y, _ in rows:
        by_series.setdefault(name, []).append((x, y))
    for name, pairs in by_series.items():
        for t in range(len(pairs)):
            held = pairs[max(0, t - width + 1) : t + 1]
            known = len(held) == width and all(x is not None for x, _ in held)
            want = plain([x for x, _ in held], [y for _, y in held]) if known else None
            assert got[name, t] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert rolling.rank_correlation(frame.limit(0), "x", "y", width, kind).count() == 0
    with pytest.raises(ValueError, match="unknown correlation"):
        rolling.rank_correlation(frame, "x", "y", width, "pearson")


def test_a_series_is_spread_over_tasks(spark):
    frame = spark.range(2000).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    whole, cut = (rolling.rank_correlation(frame, "x", "y", 63, "kendall", b).orderBy("t").collect() for b in (10**6, 200))
    assert [r["t"] for r in cut] == list(range(2000))
    assert [r["r"] for r in whole][:62] == [None] * 62 and [r["r"] for r in whole] == [r["r"] for r in cut]


def test_overlaps_by_brute_force(spark):
    rng = np.random.default_rng(2)
    sides = []
    for name in "ab":
        keys = ["hot" if rng.random() < 0.5 else f"k{rng.integers(5)}" for _ in range(150)]
        starts, sizes = rng.integers(0, 20_000, 150), rng.choice([0, 1, 60, 3600, 9000], 150)
        sides.append([(k, i, int(s), int(s + z)) for i, (k, s, z) in enumerate(zip(keys, starts, sizes, strict=True))])
    frames = [spark.createDataFrame(rows, f"key string, {name} long, s long, e long").select("key", name, F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end")) for rows, name in zip(sides, "ab", strict=True)]
    want = sorted((i, j, max(s, u), min(e, v)) for k, i, s, e in sides[0] for m, j, u, v in sides[1] if k == m and s < v and u < e and s < e and u < v)
    for width in (300, 100_000):
        joined = intervals.overlapping(*frames, ["key"], width)
        assert sorted((r[0], r[1], r[2], r[3]) for r in joined.select("a", "b", F.unix_seconds("start"), F.unix_seconds("end")).collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlapping(frames[0].limit(0), frames[1], ["key"], 300).count() == 0


def test_sketches_of_days_stand_for_the_whole(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7001).alias("user"), F.rand(1).alias("value"))
    days = sketches.daily(rows, ["k"], "ts", "user", "value")
    assert days.count() > 90
    for r in sketches.read(sketches.merged(days, ["k"]), 0.1, 0.5).collect():
        assert abs(r["distinct_count"] - 7001) <= sketches.ERROR * 7001
        below = rows.where((F.col("k") == r["k"]) & (F.col("value") <= r["q10"])).count() / r["n"]
        assert abs(below - 0.1) <= sketches.RANK_ERROR and abs(r["q50"] - 0.5) < 0.03
    monthly = sketches.merged(days.withColumn("month", F.trunc("day", "month")), ["k", "month"])
    whole, again = (sketches.read(sketches.merged(x, ["k"])).orderBy("k").collect() for x in (days, monthly))
    assert [(r["k"], r["n"], r["distinct_count"]) for r in whole] == [(r["k"], r["n"], r["distinct_count"]) for r in again]


def test_variants_of_unknown_shape(spark):
    texts = ['{"days": [{"day": 1, "value": 0.5}, {"day": 2, "value": null}], "monthly_avg": {"jan": 1.5, "feb": 2}}', '{"days": "none"}', "{bad", None, "[1, 2]", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, data string")
    read = variants.parsed(rows, "data")
    assert [r["error"] for r in read.orderBy("id").collect()] == [None, None, "no JSON: {bad", None, None, "no JSON: "]
    some = variants.fields(read, "data", first="$.days[0].value double", jan="$.monthly_avg.jan double", second="$[1] int").orderBy("id").collect()
    assert [(r["first"], r["jan"], r["second"]) for r in some] == [(0.5, 1.5, None), (None, None, None), (None, None, None), (None, None, None), (None, None, 2), (None, None, None)]
    assert sorted((r["id"], r["name"], r["value"]) for r in variants.entries(read, "data", "$.monthly_avg", "double").collect()) == [(0, "feb", 2.0), (0, "jan", 1.5)]
    days = variants.elements(read, "data", "$.days", "struct<day:int,value:double>").orderBy("at").collect()
    assert [(r["id"], r["at"], r["value"]["day"], r["value"]["value"]) for r in days] == [(0, 0, 1, 0.5), (0, 1, 2, None)]


def test_a_users_statistic_equals_the_registered_one(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(x)) for s, n in (("a", 40), ("b", 7), ("c", 1)) for t, x in enumerate(rng.normal(size=n))] + [("a", 99, None)]
    frame = spark.createDataFrame(rows, "series_id string, t int, ret double")
    own = {(r["series_id"], r["iteration"]): r["b"] for r in bootstrap.resampled(frame, np.mean, 120).collect()}
    registered = {(r["series_id"], r["iteration"]): r["b"] for r in bootstrap.resamples(frame, 120).collect()}
    assert own.keys() == registered.keys() and len(own) == 360
    assert all(own[k] == pytest.approx(registered[k]) for k in own)
    assert {r["b"] for r in bootstrap.resampled(frame, lambda x: 1 / 0, 3).collect()} == {None}
    assert bootstrap.resampled(frame.limit(0), np.mean, 3).count() == 0


def test_progress_is_the_state_at_each_batch(spark):
    rng = np.random.default_rng(4)
    drawn = [("a", i, float(x)) for i, x in enumerate(rng.normal(size=95), 1)] + [("b", i, float(i)) for i in range(1, 20)]
    got = bootstrap.progress(spark.createDataFrame(drawn, "series_id string, iteration int, b double"), 20).orderBy("series_id", "iteration").collect()
    assert [(r["series_id"], r["iteration"]) for r in got] == [("a", 20), ("a", 40), ("a", 60), ("a", 80)]
    for r in got:
        held = [b for s, i, b in drawn if s == "a" and i <= r["iteration"]]
        assert r["mean"] == pytest.approx(np.mean(held)) and r["std"] == pytest.approx(np.std(held))
        assert r["lower"] == (pytest.approx(np.quantile(held, 0.025)) if len(held) >= 30 else None)


def test_shapes_for_warping(spark):
    values = {"a": [3.0, 1.0, None, 8.0, 4.0, 4.0], "flat": [2.0, 2.0, None], "one": [5.0]}
    rows = spark.createDataFrame([(k, t, x) for k, v in values.items() for t, x in enumerate(v)], "series_id string, t int, x double")
    for method in ("zscore", "minmax", "percentile", "none"):
        got = {(r["series_id"], r["t"]): r["shape"] for r in normalize.for_warping(rows, "x", method).collect()}
        for k, v in values.items():
            held = np.array([x for x in v if x is not None])
            low, high = np.quantile(held, (0.25, 0.75))
            origin, scale = {"zscore": (held.mean(), held.std()), "minmax": (held.min(), np.ptp(held)), "percentile": (low, high - low), "none": (0, 1)}[method]
            for t, x in enumerate(v):
                want = None if x is None else pytest.approx((x - origin) / scale if scale > 1e-10 else 0.0)
                assert got[k, t] == want, (method, k, t)
    assert normalize.for_warping(rows.limit(0), "x").count() == 0
    with pytest.raises(ValueError, match="unknown method"):
        normalize.for_warping(rows, "x", "rank")
