"""Queries of operators with structures of their own: rolling ranks, interval bins, sketches,
variants, a user's statistic."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bootstrap, intervals, lineage, markets, normalize, rolling, sketches, variants, windows
from ..sources import provider, pruned
from ..sources.tables import daily_bars, hourly_bars, table, weekly_bars
from ..streaming import signals
from .registry import register

WIDTH = 63
PLACED = f"""placed AS (SELECT e.series_id, e.t, m.t AS i, m.close AS x, m.open AS y FROM bars e JOIN bars m ON m.series_id = e.series_id AND m.t BETWEEN e.t - {WIDTH - 1} AND e.t WHERE e.t >= {WIDTH - 1}),
before AS (SELECT series_id, t, NULL::DOUBLE AS r FROM bars WHERE t < {WIDTH - 1})"""
register("udf03_rolling_spearman", lambda s, d: rolling.rank_correlation(daily_bars(s, d), "close", "open", WIDTH, "spearman", 500), "daily",
    f"""WITH {PLACED}, ranked AS (SELECT series_id, t, rank() OVER (PARTITION BY series_id, t ORDER BY x) + (count(*) OVER (PARTITION BY series_id, t, x) - 1) / 2 AS a, rank() OVER (PARTITION BY series_id, t ORDER BY y) + (count(*) OVER (PARTITION BY series_id, t, y) - 1) / 2 AS b FROM placed)
    SELECT series_id, t, corr(a, b) AS r FROM ranked GROUP BY 1, 2 UNION ALL SELECT * FROM before""", "series_id:s t:i r:d")  # fmt: skip
register("udf03_rolling_kendall", lambda s, d: rolling.rank_correlation(daily_bars(s, d), "close", "open", WIDTH, "kendall", 500), "daily",
    f"""WITH {PLACED}, signs AS (SELECT a.series_id, a.t AS i, b.t AS j, sign(b.close - a.close) AS dx, sign(b.open - a.open) AS dy FROM bars a JOIN bars b ON a.series_id = b.series_id AND b.t > a.t AND b.t < a.t + {WIDTH}),
    sums AS (SELECT e.series_id, e.t, sum(dx * dy) AS s, sum(dx * dx) AS x, sum(dy * dy) AS y FROM bars e JOIN signs p ON p.series_id = e.series_id AND p.i >= e.t - {WIDTH - 1} AND p.j <= e.t AND p.j > e.t - {WIDTH} WHERE e.t >= {WIDTH - 1} GROUP BY 1, 2)
    SELECT series_id, t, s / nullif(sqrt(x * y), 0) AS r FROM sums UNION ALL SELECT * FROM before""", "series_id:s t:i r:d")  # fmt: skip


def _spread(x: np.ndarray) -> float:
    """A statistic that no registry has: the range between quartiles over the median's size."""
    low, middle, high = np.quantile(x, (0.25, 0.5, 0.75))
    return (high - low) / (1 + abs(middle))


register("udf01_user_statistic", lambda s, d: bootstrap.resampled(windows.returns(weekly_bars(s, d)), _spread, 1000), "weekly",
    """WITH known AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS p, ret AS x FROM (SELECT series_id, t, close / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY t), 0) - 1 AS ret FROM weekly) WHERE ret IS NOT NULL),
    sizes AS (SELECT series_id, count(*) AS n FROM known GROUP BY 1),
    draws AS (SELECT k.series_id, i, CAST('0x' || substr(md5(i || '-' || p), 1, 8) AS BIGINT) % n AS p FROM known k JOIN sizes USING (series_id), (SELECT unnest(range(1, 1001)) AS i))
    SELECT d.series_id, i AS iteration, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / (1 + abs(quantile_cont(x, 0.5))) AS b FROM draws d JOIN known k ON k.series_id = d.series_id AND k.p = d.p GROUP BY 1, 2""", "series_id:s iteration:i b:d")  # fmt: skip


def _spans(s: SparkSession, d: str, kinds: tuple[str, ...], name: str) -> DataFrame:
    """What a user does as spans: an event lasts as many minutes as its value says."""
    events = table(s, d, "events").where(F.col("event_type").isin(*kinds))
    end = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60) * 1_000_000).cast("bigint"))
    return events.select("user_id", F.col("event_id").alias(name), F.col("ts").cast("timestamp").alias("start"), end.alias("end"))


register("jn12_overlapping", lambda s, d: intervals.overlapping(_spans(s, d, ("click", "view"), "a"), _spans(s, d, ("purchase", "signup", "error"), "b"), ["user_id"], 1800).select("user_id", "a", "b", (F.unix_micros("end") - F.unix_micros("start")).alias("micros")), "",
    """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 60) AS BIGINT) * 1000000 AS b FROM events)
    SELECT x.user_id, x.event_id AS a, y.event_id AS b, least(x.b, y.b) - greatest(x.a, y.a) AS micros FROM e x JOIN e y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b
    WHERE x.event_type IN ('click', 'view') AND y.event_type IN ('purchase', 'signup', 'error') AND x.a < x.b AND y.a < y.b""", "user_id:i a:i b:i micros:i")  # fmt: skip


def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Whether sketches of days, united, are within their errors of exact figures."""
    events = table(s, d, "events")
    found = sketches.read(sketches.merged(sketches.daily(events, ["event_type"], "ts", "user_id", "value"), ["event_type"]), 0.5)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("rows"))
    shares = events.join(found.select("event_type", "q50"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("q50")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q50")).cast("double")).alias("upto"))
    both = found.join(exact, "event_type").join(shares, "event_type")
    close = F.abs(F.col("distinct_count") - F.col("users")) <= F.ceil(sketches.ERROR * F.col("users"))
    middle = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    return both.select("event_type", "n", "users", close.alias("distinct_is_close"), middle.alias("median_is_close"))


register("agg26_sketches", _sketched, "", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS distinct_is_close, true AS median_is_close FROM events GROUP BY 1", "event_type:s n:i users:i distinct_is_close:b median_is_close:b")


def _grouping_sets(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").withColumn("year", F.year("o_orderdate"))
    year, status, priority = F.col("year"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.groupingSets([[year, status], [priority], []], year, status, priority).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping_id().alias("level"))


register("agg26_grouping_sets", _grouping_sets, "", "SELECT year(o_orderdate) AS year, o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total, grouping_id(year(o_orderdate), o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((year(o_orderdate), o_orderstatus), (o_orderpriority), ())", "year:i o_orderstatus:s o_orderpriority:s n:i total:d level:i")


def _weighed(s: SparkSession, d: str) -> DataFrame:
    """Events with their properties read from JSON, every eleventh of which is made bad."""
    events = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props")).alias("props"))
    return variants.fields(variants.parsed(events, "props"), "props", k="$.k bigint", absent="$.days[0].value double").select("event_id", "k", "absent", "error")


register("sc19_variant_fields", _weighed, "", "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) END AS k, NULL::DOUBLE AS absent, CASE WHEN event_id % 11 = 0 THEN 'no JSON: ' || substr('x' || props, 1, 40) END AS error FROM events", "event_id:i k:i absent:d error:s")
register("sc18_variant_entries", lambda s, d: variants.entries(variants.parsed(table(s, d, "events").select("event_id", "props"), "props").drop("error"), "props", "$", "bigint"), "", "SELECT event_id, 'k' AS name, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS value FROM events WHERE props IS NOT NULL", "event_id:i name:s value:i")


#: Where each kind of event is traded: zone, minutes to its close, weekends.
MARKETS = (("click", "America/New_York", 960, False), ("view", "Europe/London", 990, False), ("purchase", "Asia/Tokyo", 900, False), ("signup", "UTC", 1440, True), ("error", "UTC", 1440, True))
_CALENDAR = "calendar AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{z}', {m}, {str(w).lower()})" for i, z, m, w in MARKETS) + ") v(series_id, zone, closes, weekends))"
_SESSIONS = f"""{_CALENDAR},
placed AS (SELECT h.*, weekends, CAST(timezone(zone, timezone('UTC', h.time)) + (1440 - closes) * INTERVAL 1 MINUTE AS DATE) AS d FROM hourly h JOIN calendar USING (series_id)),
sessions AS (SELECT series_id, d + CASE WHEN weekends THEN 0 WHEN dayofweek(d) = 6 THEN 2 WHEN dayofweek(d) = 0 THEN 1 ELSE 0 END AS day, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume, count(*) AS bars FROM placed GROUP BY 1, 2)"""


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return markets.session_bars(hourly_bars(s, d), s.createDataFrame(list(MARKETS), "series_id string, zone string, closes int, weekends boolean"))


def _beside(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d)
    always = sessions.where(F.col("series_id").isin("signup", "error")).select(F.col("series_id").alias("other_id"), "day", F.col("close").alias("other_close"))
    return markets.beside(sessions.where(~F.col("series_id").isin("signup", "error")), always)


register("jn03_session_bars", _sessions, "hourly", f"WITH {_SESSIONS} SELECT * FROM sessions", "series_id:s day:t open:d high:d low:d close:d volume:i bars:i")
register("jn03_markets_beside", _beside, "hourly",
    f"""WITH {_SESSIONS}, pairs AS (SELECT a.series_id, o.series_id AS other_id, o.day, o.close AS other_close, max(a.day) AS last FROM sessions o JOIN sessions a ON a.day <= o.day
      WHERE o.series_id IN ('signup', 'error') AND a.series_id NOT IN ('signup', 'error') AND o.day <= (SELECT max(day) FROM sessions e WHERE e.series_id = a.series_id) GROUP BY 1, 2, 3, 4)
    SELECT p.series_id, other_id, p.day, a.close, other_close, p.day > p.last AS carried FROM pairs p JOIN sessions a ON a.series_id = p.series_id AND a.day = p.last""", "series_id:s other_id:s day:t close:d other_close:d carried:b")  # fmt: skip


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Closes and those before them, by a window over a stored table, without an exchange."""
    bars = daily_bars(s, d).withColumn("timeframe", F.lit("1d")).unionByName(weekly_bars(s, d).withColumn("timeframe", F.lit("1w")))
    shared, name = s.conf.get("spark.checkpoint.dir", None), f"bars_{uuid.uuid4().hex}"
    table = pruned.save(bars.select("timeframe", "series_id", "time", "close"), name, "timeframe", "series_id", "time", 8, shared and f"{shared}/{name}")
    before = F.lag("close").over(Window.partitionBy("timeframe", "series_id").orderBy("time"))
    return table.select("timeframe", "series_id", "time", "close", before.alias("before"))


register("src23_stored_series", _stored, "daily weekly",
    """SELECT timeframe, series_id, time, close, lag(close) OVER (PARTITION BY timeframe, series_id ORDER BY time) AS before
    FROM (SELECT '1d' AS timeframe, series_id, time, close FROM bars UNION ALL SELECT '1w', series_id, time, close FROM weekly)""", "timeframe:s series_id:s time:t close:d before:d")  # fmt: skip


def _shapes(s: SparkSession, d: str) -> DataFrame:
    """Every form in which series are warped, of closes and of a constant."""
    bars = weekly_bars(s, d).withColumn("same", F.lit(7.5))
    for method in ("zscore", "minmax", "percentile", "none"):
        bars = normalize.for_warping(normalize.for_warping(bars, "close", method, method), "same", method, f"same_{method}")
    return bars.select("series_id", "t", "zscore", "minmax", "percentile", "none", "same_zscore", "same_minmax", "same_percentile", "same_none")


register("nrm13_shapes", _shapes, "weekly",
    """SELECT series_id, t, CASE WHEN stddev_pop(close) OVER v < 1e-10 THEN 0 ELSE (close - avg(close) OVER v) / nullif(stddev_pop(close) OVER v, 0) END AS zscore,
    CASE WHEN max(close) OVER v - min(close) OVER v < 1e-10 THEN 0 ELSE (close - min(close) OVER v) / nullif(max(close) OVER v - min(close) OVER v, 0) END AS minmax,
    CASE WHEN quantile_cont(close, 0.75) OVER v - quantile_cont(close, 0.25) OVER v < 1e-10 THEN 0 ELSE (close - quantile_cont(close, 0.25) OVER v) / nullif(quantile_cont(close, 0.75) OVER v - quantile_cont(close, 0.25) OVER v, 0) END AS percentile,
    close AS none, stddev_pop(7.5 + 0 * t) OVER v AS same_zscore, 0 * t AS same_minmax, 0 * t AS same_percentile, 7.5 + 0 * t AS same_none FROM weekly WINDOW v AS (PARTITION BY series_id)""",
    "series_id:s t:i zscore:d minmax:d percentile:d none:d same_zscore:d same_minmax:d same_percentile:d same_none:d")


register("win11_percentile_so_far", lambda s, d: rolling.percentile_so_far(daily_bars(s, d), "close", 500, 16), "daily",
    "SELECT a.series_id, a.t, a.close, count(*) FILTER (b.close <= a.close) / count(*) AS percentile FROM bars a JOIN bars b ON a.series_id = b.series_id AND b.t <= a.t GROUP BY 1, 2, 3", "series_id:s t:i close:d percentile:d")


def _altered(s: SparkSession, d: str) -> DataFrame:
    """Orders with some left out, some changed."""
    orders = table(s, d, "orders").where("o_orderkey % 1009 <> 5")
    return orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 997 == 7, "x").otherwise(F.col("o_orderpriority")))


def _changed(s: SparkSession, d: str) -> DataFrame:
    """Orders that differ between two versions, found by their trees."""
    sides, columns = (table(s, d, "orders"), _altered(s, d)), ["o_orderpriority"]
    trees = [lineage.tree(x, "o_orderkey", columns, "v1", 64, 64, 3) for x in sides]
    return lineage.changed_rows(*sides, lineage.changed_ranges(*trees, 64, 3), "o_orderkey", columns, 64)


register("lin01_tree", lambda s, d: lineage.tree(table(s, d, "orders"), "o_orderkey", ["o_orderpriority"], "v1", 64, 64, 3).drop("checksum"), "",
    """SELECT level, node, min(low) AS low, max(high) AS high, sum(n) AS n, lpad(printf('%x', bit_xor(b0)), 15, '0') || lpad(printf('%x', bit_xor(b1)), 15, '0') || lpad(printf('%x', bit_xor(b2)), 15, '0') || lpad(printf('%x', bit_xor(b3)), 15, '0') AS hash, 'v1' AS version FROM (
      SELECT level, CAST(floor(leaf / [1, 64, 4096][level + 1]) AS BIGINT) AS node, low, high, n, CAST('0x' || substr(h, 1, 15) AS BIGINT) AS b0, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b1, CAST('0x' || substr(h, 31, 15) AS BIGINT) AS b2, CAST('0x' || substr(h, 46, 15) AS BIGINT) AS b3 FROM (
        SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS leaf, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n, sha256(string_agg(sha256(o_orderkey || '|' || coalesce(o_orderpriority, '\\N')), '' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1), (SELECT unnest(range(3)) AS level)) GROUP BY 1, 2""",
    "level:i node:i low:i high:i n:i hash:s version:s")
register("lin02_changed_rows", _changed, "",
    "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 1009 = 5 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 1009 = 5 OR (o_orderkey % 997 = 7 AND o_orderpriority IS DISTINCT FROM 'x')", "key:i change:s")


def _provided(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars given to a provider's folder and read back, two kinds of one half-year."""
    bars = hourly_bars(s, d).select("series_id", F.to_date("time").alias("day"), "time", "open", "high", "low", "close", "volume")
    shared = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    folder = f"{shared or tempfile.mkdtemp()}/provided_{uuid.uuid4().hex}"
    bars.repartition("day").write.partitionBy("day", "series_id").csv(folder, header=True)
    provider.register(s)
    read = s.read.format("provider").load(folder).where(F.col("series_id").isin("click", "purchase") & (F.col("day") >= F.lit("2024-01-10").cast("date")))
    return read.select("series_id", "time", "open", "high", "low", "close", "volume")


register("udf07_provider", _provided, "hourly", "SELECT series_id, time, open, high, low, close, volume FROM hourly WHERE series_id IN ('click', 'purchase') AND time >= TIMESTAMP '2024-01-10'", "series_id:s time:t open:d high:d low:d close:d volume:i")
register("str08_signal_spans", lambda s, d: signals.spans(table(s, d, "events").select(F.col("user_id").alias("signal_id"), F.col("ts").alias("time"), F.col("value").alias("strength")), 2), "",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS signal_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value NULLS FIRST) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY signal_id ORDER BY i) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM e),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY signal_id ORDER BY i) AS span FROM m)
    SELECT signal_id, min(ts) AS started, max(ts) + INTERVAL 2 DAY AS expired, count(*) AS n, arg_max(value, i) AS strength FROM g GROUP BY signal_id, span""", "signal_id:s started:t expired:t n:i strength:d")  # fmt: skip
