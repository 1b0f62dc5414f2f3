"""Column expressions that the operators share. All of them stay inside codegen.

Missing values are SQL nulls; NaN and infinities are turned into nulls by ``finite``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_time(frame: tuple[int, int] | None = None, key: str = "series_id", order: str = "t") -> WindowSpec:
    """The window of a series in time order, with a frame of rows if given."""
    spec = Window.partitionBy(key).orderBy(order)
    return spec.rowsBetween(*frame) if frame else spec


def trailing(width: int, key: str = "series_id", order: str = "t") -> WindowSpec:
    return by_time((-(width - 1), 0), key, order)


def whole(key: str = "series_id") -> WindowSpec:
    return Window.partitionBy(key)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """``x`` between the bounds; null stays null."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def divided(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def log_return(x: Column, over: WindowSpec) -> Column:
    previous = F.lag(x).over(over)
    return F.when((x > 0) & (previous > 0), F.ln(x / previous))


def simple_return(x: Column, over: WindowSpec) -> Column:
    return divided(x, F.lag(x).over(over)) - 1


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    """Both columns, null wherever one of them is."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def correlation(x: Column, y: Column, over: WindowSpec | None = None, least: int = 3) -> Column:
    """Pearson's r as an aggregate or over a window; null for fewer than ``least`` pairs or
    a constant side."""
    x, y = pair(x, y)

    def at(c: Column) -> Column:
        return c.over(over) if over is not None else c

    spread = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    r = divided(at(F.covar_pop(x, y)), F.when(spread > 1e-12, spread))
    return F.when(at(F.count(x)) >= least, r)


def average_rank(x: Column, partition: list[Column | str]) -> Column:
    """Ranks with ties averaged; null for null."""
    ordered = Window.partitionBy(*partition).orderBy(x)
    peers = Window.partitionBy(*partition, x)
    below = F.rank().over(ordered) - F.count(F.when(x.isNull(), 1)).over(Window.partitionBy(*partition))
    return F.when(x.isNotNull(), below + (F.count(x).over(peers) - 1) / 2)


def percentile_rank(x: Column, partition: list[Column | str], kind: str = "mean") -> Column:
    """Share of values below ``x``: strict, weak (at or below), mean of both, or rank."""
    peers = F.count(x).over(Window.partitionBy(*partition, x))
    nulls = F.count(F.when(x.isNull(), 1)).over(Window.partitionBy(*partition))
    less = F.rank().over(Window.partitionBy(*partition).orderBy(x)) - 1 - nulls
    at_most = less + peers
    n = F.count(x).over(Window.partitionBy(*partition))
    share = {"strict": less / n, "weak": at_most / n, "mean": (less + at_most) / (2 * n), "rank": (less + at_most + 1) / (2 * n)}
    alias = {"average": "mean", "min": "strict", "max": "weak"}
    if alias.get(kind, kind) not in share:
        raise ValueError(f"unknown kind of rank: {kind}")
    return F.when(x.isNotNull(), share[alias.get(kind, kind)])


def rolling_rank(x: Column, over: WindowSpec, kind: str = "mean") -> Column:
    """Rank of the current value within its frame; the frame's width bounds the list."""
    values = F.collect_list(x).over(over)
    less = F.size(F.filter(values, lambda v: v < x))
    at_most = F.size(F.filter(values, lambda v: v <= x))
    n = F.size(values)
    found = {"strict": less / n, "weak": at_most / n, "mean": (less + at_most) / (2 * n), "rank": (less + at_most + 1) / (2 * n)}[kind]
    return F.when(x.isNotNull(), found)


def run_length(holds: Column, over: WindowSpec) -> tuple[Column, Column]:
    """(island, step) for counting consecutive rows on which ``holds``: number rows with
    ``step`` summed over (partition, island)."""
    holds = F.coalesce(holds, F.lit(False))
    return F.sum(F.when(holds, 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0)), F.when(holds, 1).otherwise(0)


def year_digit(time: Column) -> Column:
    return F.pmod(F.year(time), F.lit(10))


def decayed(initial: Column, age: Column, half_life: Column) -> Column:
    """Strength of a signal after ``age`` days."""
    return initial * F.pow(F.lit(0.5), age / half_life)


def premium(price: Column, nav: Column) -> Column:
    """Price above net asset value in percent."""
    return divided(price - nav, nav) * 100


def interpolated(x: Column, points: list[tuple[Column, Column]]) -> Column:
    """Piecewise-linear interpolation through ascending (x, y) points, flat outside."""
    out = points[-1][1]
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        step = F.coalesce(divided(x - x0, x1 - x0), F.lit(0.0))
        out = F.when(x <= x1, y0 + (y1 - y0) * step).otherwise(out)
    return F.when(x.isNull(), None).when(x <= points[0][0], points[0][1]).otherwise(out)


DISTANCES = {
    "euclidean": lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)),
    "manhattan": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v),
    "cosine": lambda a, b: 1
    - divided(
        F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v),
        F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v)),
    ),
}


def distance(name: str, a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles; an unknown name is Euclidean."""
    return DISTANCES.get(name, DISTANCES["euclidean"])(a, b)
