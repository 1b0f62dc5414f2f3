"""Numeric kernels for one series at a time: recurrences that no column expresses.

All are pure functions of arrays without missing values, linear or near-linear in the
length of the series unless stated.
"""

from __future__ import annotations

import math

import numpy as np

#: Cells of a local regression held at once (a few arrays of 8 bytes each).
LOESS_CELLS = 1 << 18


def hodrick_prescott(y: np.ndarray, smoothing: float) -> np.ndarray:
    """Trend that solves (I + s D'D) trend = y, D the second difference: five diagonals,
    eliminated from the top (LDL')."""
    n = len(y)
    if n < 3:
        raise ValueError("three points at least")
    main = np.full(n, 6.0)
    main[[0, -1]] = 1.0
    main[[1, -2]] = 5.0 if n > 3 else 4.0
    one, two = np.full(n - 1, -4.0), np.ones(n - 2)
    one[[0, -1]] = -2.0
    # Plain floats: a recurrence over them is several times as fast as over array elements.
    rows = zip((1 + smoothing * main).tolist(), [0.0, *(smoothing * one)], [0.0, 0.0, *(smoothing * two)], y.tolist(), strict=True)
    near, far, scaled = [], [], []
    d1 = d2 = 1.0
    k1 = z1 = z2 = 0.0
    for diagonal, a, b, value in rows:
        k2 = b / d2
        a -= b * k1
        k = a / d1
        d = diagonal - k * a - k2 * b
        z = value - k * z1 - k2 * z2
        near.append(k)
        far.append(k2)
        scaled.append(z / d)
        d1, d2, k1, z1, z2 = d, d1, k, z, z1
    near, far, out = [*near, 0.0], [*far, 0.0, 0.0], np.empty(n)
    x1 = x2 = 0.0
    for i in range(n - 1, -1, -1):
        x1, x2 = scaled[i] - near[i + 1] * x1 - far[i + 2] * x2, x1
        out[i] = x1
    return out


def loess(y: np.ndarray, window: int, degree: int = 1, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression on positions 0..n-1 with tricube weights over the ``window``
    nearest positions, evaluated at ``at`` (the positions themselves by default)."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    robust = np.ones(n) if weights is None else weights
    q = min(window, n)
    lefts = np.clip(np.ceil(at - q / 2), 0, n - q).astype(int)
    values, trust = np.lib.stride_tricks.sliding_window_view(y, q), np.lib.stride_tricks.sliding_window_view(robust, q)
    out = np.empty(len(at))
    some = max(1, LOESS_CELLS // q)
    for first in range(0, len(at), some):
        left, x0 = lefts[first : first + some], at[first : first + some]
        x = left[:, None] + np.arange(q) - x0[:, None]
        reach = np.maximum(np.abs(x[:, 0]), np.abs(x[:, -1])) * max(1.0, window / n)
        u = np.abs(x) / np.where(reach > 0, reach, 1.0)[:, None]
        near = np.clip(1 - u * u * u, 0, None)
        w, part = near * near * near * trust[left], values[left]
        total = w.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        mean = (w * part).sum(axis=1) / safe
        if degree == 1:
            m = (w * x).sum(axis=1) / safe
            off = x - m[:, None]
            var = (w * off * off).sum(axis=1)
            fitted = np.where(var > 1e-12, mean - m * (w * off * part).sum(axis=1) / np.where(var > 1e-12, var, 1.0), mean)
        elif degree:
            root = np.sqrt(w)
            basis = np.stack([root, root * x, root * x * x], axis=2)
            fitted = (np.linalg.pinv(basis)[:, 0, :] * part * root).sum(axis=1)
        else:
            fitted = mean
        out[first : first + some] = np.where(total > 0, fitted, part.mean(axis=1))
    return out


def bisquare(residual: np.ndarray) -> np.ndarray:
    """Robustness weights: six median absolute residuals is the limit."""
    limit = 6 * np.median(np.abs(residual))
    return np.clip(1 - (np.abs(residual) / limit) ** 2, 0, None) ** 2 if limit > 0 else np.ones(len(residual))


def _average(x: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[width:] - sums[:-width]) / width


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = False, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal-trend decomposition by local regression: (trend, seasonal, residual).

    Cycle-subseries are smoothed and extended by a period at both ends; a low-pass of them
    (moving averages of one period twice and of three, then local regression) is taken off,
    so the seasonal part averages out over a period and an exactly periodic series leaves
    no residual.
    """
    n = len(y)
    if n < 2 * period:
        raise ValueError("two periods at least")
    seasonal += 1 - seasonal % 2
    if trend is None:
        trend = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    trend += 1 - trend % 2
    low = period + 1 - period % 2
    trended, season, weights = np.zeros(n), np.zeros(n), None
    for _ in range(1 + (outer if robust else 0)):
        for _ in range(inner):
            rough = y - trended
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                part = rough[phase::period]
                w = None if weights is None else weights[phase::period]
                cycle[phase::period] = loess(part, seasonal, 1, w, np.arange(-1, len(part) + 1, dtype=float))
            smooth = _average(_average(_average(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(smooth, low)
            trended = loess(y - season, trend, 1, weights)
        if robust:
            weights = bisquare(y - trended - season)
    return trended, season, y - trended - season


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-entropy autoregression: (coefficients, reflections, noise variance).
    Coefficients are updated together; reflections stay within 0.99."""
    forward, backward = x[1:].astype(float), x[:-1].astype(float)
    a, noise = np.array([1.0]), float(np.mean(x**2))
    found = []
    for _ in range(order):
        below = float((forward**2 + backward**2).sum())
        k = 0.0 if below < 1e-12 else float(np.clip(-2 * (forward * backward).sum() / below, -0.99, 0.99))
        found.append(k)
        padded = np.append(a, 0.0)
        a = padded + k * padded[::-1]
        noise *= 1 - k * k
        forward, backward = (forward + k * backward)[1:], (backward + k * forward)[:-1]
    return a[1:], np.array(found), noise


def spectrum(coefficients: np.ndarray, noise: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies from 0 to half a cycle per step, and power scaled to a maximum of 1."""
    frequencies = np.linspace(0, 0.5, points)
    phases = np.exp(-2j * np.pi * np.outer(frequencies, np.arange(1, len(coefficients) + 1)))
    power = noise / np.abs(1 + phases @ coefficients) ** 2
    return frequencies, power / power.max()


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Dynamic time warping: (distance, path), absolute differences as cost, within a
    Sakoe-Chiba band widened to the difference in length. Ties prefer insertion, then
    deletion, then match. Costs n*band steps, taken along anti-diagonals."""
    n, m = len(a), len(b)
    if not n or not m:
        raise ValueError("an empty series")
    band = max(n, m) if band is None else max(band, abs(n - m))
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    cost = np.abs(np.subtract.outer(a, b))
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        i = i[np.abs(2 * i - s) <= band]
        if len(i):
            j = s - i
            total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j], total[i, j - 1]), total[i - 1, j - 1])
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        steps = (total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
        k = int(np.argmin(steps))
        i, j = (i - 1, j) if k == 0 else (i, j - 1) if k == 1 else (i - 1, j - 1)
    return float(total[n, m]), path[::-1]


def inversions(y: np.ndarray) -> int:
    """Pairs in which a larger value comes before a smaller one, by halves."""
    if len(y) < 2:
        return 0
    a, b = y[: len(y) // 2], y[len(y) // 2 :]
    return inversions(a) + inversions(b) + int((len(a) - np.searchsorted(np.sort(a), b, side="right")).sum())


def kendall(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b by counting inversions; None where a side has no two values."""

    def tied(*columns: np.ndarray) -> int:
        counts = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
        return int((counts * (counts - 1) // 2).sum())

    n = len(x) * (len(x) - 1) // 2
    in_x, in_y, in_both = tied(x), tied(y), tied(x, y)
    if n == in_x or n == in_y:
        return None
    balance = n - in_x - in_y + in_both - 2 * inversions(y[np.lexsort((y, x))])
    return balance / math.sqrt(n - in_x) / math.sqrt(n - in_y)


def smaller_before(ranks: np.ndarray) -> np.ndarray:
    """Of each place in a permutation of 0 to n - 1, how many places before it hold a smaller
    number: at every level of a binary tree over places, in order of rank, a right half's
    member counts the members of the left half that it has met. O(n log n) in arrays."""
    n = len(ranks)
    out, by_rank = np.zeros(n, np.int64), np.argsort(ranks, kind="stable")
    level = 1
    while level < n:
        order = by_rank[np.argsort(by_rank // (2 * level), kind="stable")]
        left = order // level % 2 == 0
        met = np.cumsum(left)
        pair = order // (2 * level)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        before = np.repeat((met - left)[first], np.diff(np.concatenate([first, [n]])))
        out[order] += np.where(left, 0, met - before)
        level *= 2
    return out


def no_larger_before(x: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """Of each value, how many values before it are no larger; with ``part`` (ascending), only
    those of earlier parts."""
    n = len(x)
    place = np.arange(n)
    if part is None:
        part = place
    at = np.lexsort((place, -x, part))
    found = np.empty(n, np.int64)
    by_value = np.lexsort((-place, part[at], x[at]))
    ranks = np.empty(n, np.int64)
    ranks[by_value] = place
    found[at] = smaller_before(ranks)
    return found


def shares_so_far(x: np.ndarray) -> np.ndarray:
    """Of each value, the share of values up to it that are no larger."""
    return (no_larger_before(x) + 1) / np.arange(1, len(x) + 1)


def surrogate(x: np.ndarray, seed: int) -> np.ndarray:
    """A series with the same amplitude spectrum and mean, and random phases."""
    n = len(x)
    parts = np.fft.rfft(x)
    turns = np.exp(2j * np.pi * np.random.default_rng(seed).random(len(parts)))
    turns[0] = 1
    if n % 2 == 0:
        turns[-1] = np.sign(turns[-1].real) or 1
    return np.fft.irfft(parts * turns, n)


def beta_share(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of Pearson's r over n pairs."""
    return 1.0 if n < 3 else beta_share(1 - min(1.0, r * r), (n - 2) / 2, 0.5)


def f_test_p(f: float, above: int, below: int) -> float:
    """Upper tail of the F distribution."""
    return beta_share(below / (below + above * f), below / 2, above / 2) if f > 0 else 1.0
