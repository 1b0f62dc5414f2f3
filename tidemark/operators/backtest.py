"""Backtests: simulation with costs, metrics, splits, gates; lineage hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TRADING_DAYS, by_time, divided


def simulated(rows: DataFrame, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """``rows`` (series_id, t, close, signal) with the position held (the signal of the row
    before), the strategy's return after costs, equity, drawdown and ``trade``: islands of
    one position."""
    w = by_time()
    held = F.coalesce(F.lag("signal").over(w), F.lit(0.0))
    ret = F.coalesce(divided(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    moved = rows.withColumns({"position": held, "market_ret": ret})
    change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    paid = moved.withColumns({"ret": F.col("position") * F.col("market_ret") - change * (commission + slippage), "_new": (change > 0).cast("long")})
    so_far = by_time((Window.unboundedPreceding, 0))
    grown = paid.withColumns({"equity": F.exp(F.sum(F.log1p("ret")).over(so_far)), "trade": F.sum("_new").over(so_far)}).drop("_new")
    return grown.withColumn("drawdown", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(so_far)))


def trades(simulation: DataFrame) -> DataFrame:
    """One row per trade: side, bars held, compounded return."""
    held = simulation.where("position <> 0")
    return held.groupBy("series_id", "trade").agg(F.first("position").alias("side"), F.min("t").alias("entry_t"), F.count("*").alias("bars"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("pnl"))


def _sharpe(x: Column, spread: Column) -> Column:
    return F.coalesce(divided(x, F.when(spread > 1e-15, spread)), F.lit(0.0)) * F.sqrt(F.lit(float(TRADING_DAYS)))


def metrics(simulation: DataFrame, extra: list[str] | None = None, risk_free: float = 0.0) -> DataFrame:
    """One row per series (and ``extra`` columns, such as a split)."""
    keys = ["series_id", *(extra or [])]
    daily = F.col("ret") - risk_free / TRADING_DAYS
    down = F.when(daily < 0, daily * daily).otherwise(F.lit(0.0))
    island = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    under = simulation.withColumn("_peak", F.count_if(F.col("drawdown") <= 0).over(island))
    spells = under.where("drawdown > 0").groupBy(*keys, "_peak").agg(F.count("*").alias("_d")).groupBy(*keys).agg(F.max("_d").alias("max_drawdown_duration"))
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    bars = simulation.groupBy(*keys).agg(
        F.count("*").alias("bars"), total.alias("total_return"), (F.pow(1 + total, TRADING_DAYS / F.count("*")) - 1).alias("cagr"),
        _sharpe(F.avg(daily), F.stddev_pop(daily)).alias("sharpe"), _sharpe(F.avg(daily), F.sqrt(F.avg(down))).alias("sortino"), F.max("drawdown").alias("max_drawdown"),
    )
    deals = simulation.where("position <> 0").groupBy(*keys, "trade").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("pnl"), F.count("*").alias("held"))
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(F.lit(0.0))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(F.lit(0.0)))
    by_trade = deals.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("winning"), F.count_if(F.col("pnl") < 0).alias("losing"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        divided(won, lost).alias("profit_factor"), F.avg("pnl").alias("expectancy"), F.avg("held").alias("avg_trade_duration"),
    )
    none = {"trades": 0, "winning": 0, "losing": 0, "max_drawdown_duration": 0}
    return bars.join(by_trade, keys, "left").join(spells, keys, "left").fillna(none)


def progress(simulation: DataFrame, batch: int) -> DataFrame:
    """State of each series' backtest after every ``batch`` bars and after its last: share
    done, total return, deepest drawdown and trades so far."""
    so_far = by_time((Window.unboundedPreceding, 0))
    rows = simulation.select(
        "series_id", "t", F.row_number().over(by_time()).cast("long").alias("bars"), F.count("*").over(Window.partitionBy("series_id")).alias("_n"),
        (F.col("equity") - 1).alias("total_return"), F.max("drawdown").over(so_far).alias("max_drawdown"), F.col("trade").alias("trades"),
    )
    kept = rows.where((F.col("bars") % batch == 0) | (F.col("bars") == F.col("_n")))
    return kept.withColumn("share", F.col("bars") / F.col("_n")).drop("_n")


def split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """``sample``: in for the first ``share`` of each series, out for the rest."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    return rows.withColumn("sample", F.when(F.col("t") < F.floor(n * share), "in").otherwise("out"))


def folds(rows: DataFrame, count: int = 5) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("series_id"))
    return rows.withColumn("fold", F.least(F.lit(count - 1), F.floor(F.col("t") * count / n)).cast("long"))


def steadiness(by_fold: DataFrame, most: float = 0.5) -> DataFrame:
    """Spread of Sharpe over folds, and whether it stays below ``most``."""
    return by_fold.groupBy("series_id").agg(F.stddev_pop("sharpe").alias("sharpe_std"), F.count("*").alias("folds")).withColumn("is_steady", F.col("sharpe_std") < most)


def gated(found: DataFrame, max_drawdown: float = 0.25) -> DataFrame:
    """Whether a backtest passes every bound, p-value and interval included if present."""
    passes = (F.col("sharpe") > 1) & (F.col("win_rate") > 0.5) & (F.col("max_drawdown") < max_drawdown)
    if "p_value" in found.columns:
        passes = passes & (F.col("p_value") < 0.05) & (F.col("lower") > 0)
    return found.withColumn("passes", F.coalesce(passes, F.lit(False)))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text; a null differs from an empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def source_hash(rows: DataFrame, keys: list[str], columns: list[str], parts: int = 1024) -> DataFrame:
    """One hash per source, whatever its order: row hashes meet in ``parts`` by their first
    digits, each part's hashes are hashed in order, then the parts'. No task holds more
    than a part of a source."""
    hashed = rows.select(*keys, row_hash(columns).alias("h"))
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % parts
    inner = hashed.groupBy(*keys, part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("ph"), F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ph"))), lambda x: x["ph"]), "")
    return inner.groupBy(*keys).agg(F.sha2(listed, 256).alias("hash"), F.sum("n").alias("row_count"))


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Per signal its rows' ``columns`` as one array, in order."""
    return rows.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def linked(records: DataFrame, source: str) -> DataFrame:
    """``records`` (signal_id, steps: array of step, name, version, parameters, in order)
    with ``links``, a link a step with its input and output hash."""
    begin = F.array(F.struct(F.lit(0).cast("long").alias("step"), F.lit("").alias("name"), F.lit("").alias("input_hash"), F.lit(source).alias("output_hash")))

    def link(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)["output_hash"]
        out = F.sha2(F.concat_ws("|", s["name"], s["version"], s["parameters"], last), 256)
        return F.concat(done, F.array(F.struct(s["step"].alias("step"), s["name"].alias("name"), last.alias("input_hash"), out.alias("output_hash"))))

    return records.withColumn("links", F.slice(F.aggregate("steps", begin, link), 2, F.size("steps")))


def chained(steps: DataFrame, source: str) -> DataFrame:
    """``steps`` (signal_id, step, name, version, parameters) with input and output hashes:
    each output covers the step and its input, which is the output before."""
    records = _listed(steps, "steps", "step", "name", "version", "parameters")
    return linked(records, source).select("signal_id", F.explode("links").alias("s")).select("signal_id", "s.*")


def verified(chain: DataFrame) -> DataFrame:
    """Per signal: whether each input is the output before; LN003 marks a broken chain."""
    before = F.lag("output_hash").over(Window.partitionBy("signal_id").orderBy("step"))
    good = chain.withColumn("_ok", before.isNull() | (before == F.col("input_hash")))
    found = good.groupBy("signal_id").agg(F.bool_and("_ok").alias("is_valid"), F.count("*").alias("steps"))
    return found.withColumn("error", F.when(~F.col("is_valid"), F.lit("LN003")))


def recomputed(chain: DataFrame, steps: DataFrame, source: str) -> DataFrame:
    """``rechecked`` for a chain and the recorded steps in tables of their own, which meet
    as one row a signal."""
    links = _listed(chain, "links", "step", "input_hash", "output_hash")
    return rechecked(links.join(_listed(steps, "steps", "step", "name", "version", "parameters"), "signal_id", "left"), source)


def rechecked(records: DataFrame, source: str) -> DataFrame:
    """As ``verified``, with every output hash computed anew from the recorded step (name,
    version, parameters) and its input, and the first input held against the source.

    ``records`` hold a chain (``links``, in order) beside its recorded ``steps``, so that no
    hash is shuffled. A signal in several records is no valid chain: the second begins at
    the source, not at an output."""

    def holds(link: Column, i: Column) -> Column:
        def gives(s: Column) -> Column:
            again = F.sha2(F.concat_ws("|", s["name"], s["version"], s["parameters"], link["input_hash"]), 256)
            return (s["step"] == link["step"]) & (again == link["output_hash"])

        before = F.when(i == 0, F.lit(source)).otherwise(F.get("links", i - 1)["output_hash"])
        # A link's record mostly has its place; a search of all would square long chains.
        recorded = F.coalesce(gives(F.get("steps", i)), F.lit(False)) | F.exists("steps", gives)
        return F.coalesce((before == link["input_hash"]) & recorded, F.lit(False))

    valid = F.forall(F.transform("links", holds), lambda x: x)
    each = records.select("signal_id", valid.alias("_ok"), F.size("links").cast("long").alias("_n"))
    found = each.groupBy("signal_id").agg((F.bool_and("_ok") & (F.count("*") == 1)).alias("is_valid"), F.sum("_n").alias("steps"))
    return found.withColumn("error", F.when(~F.col("is_valid"), F.lit("LN003")))


def audited(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per changed value: key, column, old and new, as text."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
        return df.select(key, F.explode(pairs).alias("column", name))

    both = long(before, "old").join(long(after, "new"), [key, "column"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def exported(chain: DataFrame) -> DataFrame:
    """Per signal its lineage as one JSON text, steps in order."""
    steps = F.sort_array(F.collect_list(F.struct("step", "name", "input_hash", "output_hash")))
    return chain.groupBy("signal_id").agg(steps.alias("steps")).select("signal_id", F.to_json(F.struct("signal_id", "steps")).alias("json"))
