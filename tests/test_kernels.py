import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from tidemark.functions import kernels

series = arrays(float, st.integers(3, 25), elements=st.floats(-100, 100))


@settings(max_examples=50, deadline=None)
@given(series, st.floats(0.1, 1e5))
def test_hodrick_prescott_solves_the_dense_system(y, smoothing):
    d = np.diff(np.eye(len(y)), 2, axis=0)
    dense = np.linalg.solve(np.eye(len(y)) + smoothing * d.T @ d, y)
    assert np.allclose(kernels.hodrick_prescott(y, smoothing), dense, atol=1e-4)


def brute_dtw(a, b):
    best = math.inf

    def walk(i, j, cost):
        nonlocal best
        cost += abs(a[i] - b[j])
        if (i, j) == (len(a) - 1, len(b) - 1):
            best = min(best, cost)
            return
        for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
            if x < len(a) and y < len(b):
                walk(x, y, cost)

    walk(0, 0, 0.0)
    return best


@settings(max_examples=30, deadline=None)
@given(arrays(float, st.integers(1, 5), elements=st.floats(-9, 9)), arrays(float, st.integers(1, 5), elements=st.floats(-9, 9)))
def test_dtw_is_the_cheapest_path(a, b):
    distance, path = kernels.dtw(a, b)
    assert distance == pytest.approx(brute_dtw(a, b), abs=1e-9)
    assert sum(abs(a[i] - b[j]) for i, j in path) == pytest.approx(distance, abs=1e-9)
    assert path[0] == (0, 0)
    assert path[-1] == (len(a) - 1, len(b) - 1)
    assert kernels.dtw(b, a)[0] == pytest.approx(distance, abs=1e-9)


def test_dtw_of_equal_series_is_zero():
    x = np.sin(np.arange(50.0))
    assert kernels.dtw(x, x, 3)[0] == 0
    assert kernels.dtw(x, np.repeat(x, 2))[0] == 0


def test_stl_takes_an_exact_period_apart():
    t = np.arange(120.0)
    trend, season, rest = kernels.stl(100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12), 12, robust=False)
    assert np.abs(rest).max() < 0.5
    assert np.corrcoef(season, np.sin(2 * np.pi * t / 12))[0, 1] > 0.999
    assert np.allclose(trend + season + rest, 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12))
    with pytest.raises(ValueError, match="periods"):
        kernels.stl(t[:20], 12)


def test_loess_keeps_a_line():
    t = np.arange(30.0)
    assert np.allclose(kernels.loess(2 * t + 1, 9), 2 * t + 1)
    assert np.allclose(kernels.loess(t**2, 9, degree=2), t**2)


def test_burg_finds_a_period():
    t = np.arange(400.0)
    x = np.sin(2 * np.pi * t / 20) + 0.1 * np.random.default_rng(1).normal(size=400)
    a, k, noise = kernels.burg(x, 20)
    frequency, power = kernels.spectrum(a, noise, 400)
    assert 1 / frequency[power.argmax()] == pytest.approx(20, rel=0.05)
    assert k[0] == pytest.approx(-2 * (x[1:] * x[:-1]).sum() / (x[1:] ** 2 + x[:-1] ** 2).sum())


def test_surrogate_keeps_the_spectrum():
    x = np.random.default_rng(2).normal(size=101)
    y = kernels.surrogate(x, 5)
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y)))
    assert y.mean() == pytest.approx(x.mean())
    assert not np.allclose(x, y)


def test_p_values():
    assert kernels.beta_share(0.5, 2, 2) == pytest.approx(0.5)
    assert kernels.correlation_p(0.0, 20) == pytest.approx(1.0)
    assert kernels.correlation_p(0.632, 10) == pytest.approx(0.05, abs=1e-3)  # the table's critical r
    assert kernels.f_test_p(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    values = [kernels.correlation_p(r, 15) for r in (0.1, 0.3, 0.5, 0.9)]
    assert all(a > b for a, b in itertools.pairwise(values))
