"""Trends of long series against the pair by pair form, with ties, levels, steps and nearly equal slopes."""

import math
import subprocess
import sys
import time

import numpy as np
import pytest

from terrafold.operators import trend as T


def pairwise(x: np.ndarray) -> tuple[float, float]:
    i, j = np.triu_indices(len(x), 1)
    d = x[j] - x[i]
    return np.sign(d).sum(), np.median(d / (j - i))


def series(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    at = np.arange(n)
    return {
        "normal": rng.normal(size=n),
        "rising": 0.37 * at + rng.normal(size=n),
        "ties": rng.integers(0, 4, n).astype(float),
        "level": np.full(n, 2.5),
        "mostly level": np.where(rng.random(n) < 0.02, 1.0, 0.0),
        "line": 0.1 * at,
        "whole line": 3.0 * at,
        "steps": (at // 7).astype(float),
        "large": 1e9 + rng.integers(0, 100, n),
        "heavy": rng.standard_cauchy(n),
        "tenths": np.round(rng.random(n) * 50, 1),
    }[kind]


KINDS = ("normal", "rising", "ties", "level", "mostly level", "line", "whole line", "steps", "large", "heavy", "tenths")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [2, 3, 4, 5, 30, 31, 200, 1001])
@pytest.mark.parametrize("listed", [1 << 18, 64])
def test_long_form_equals_pairs(kind, n, listed, monkeypatch):
    monkeypatch.setattr(T, "PAIRWISE", 1)
    monkeypatch.setattr(T, "LISTED", listed)
    x = series(kind, n)
    s, slope = pairwise(x)
    got = T.series_trend(x[None, :])
    assert got["s"][0] == s
    assert math.isclose(got["slope"][0], slope, rel_tol=1e-9, abs_tol=1e-12 * (1 + np.abs(x).max()))
    k = np.unique(x, return_counts=True)[1]
    assert got["var_s"][0] == (n * (n - 1) * (2 * n + 5) - (k * (k - 1) * (2 * k + 5)).sum()) / 18


def test_inversions_equal_counting_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        order = rng.permutation(n)
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if order[i] > order[j]]
        assert T.inversions(order) == len(want)
        if n > 1:
            i, j = T._inverted(order, 10**6)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_hundred_thousand_values_in_little_memory():
    """Its pairs would take 80 GB; the process grows by less than 100 MB."""
    code = f"""
import sys, resource; sys.path[:0] = {sys.path!r}
import numpy as np
from terrafold.operators import trend as T
x = 0.01 * np.arange(100_000) + np.random.default_rng(1).normal(size=100_000).round(1)
T.series_trend(x[None, :2000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = T.series_trend(x[None, :])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, got["slope"][0])
"""
    began = time.time()
    grown, slope = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    # Kilobytes.
    assert int(grown) < 100_000
    assert abs(float(slope) - 0.01) < 1e-5 and time.time() - began < 120


def test_long_and_short_series_together(spark):
    rows = [(k, t, float(v)) for k, n in (("long", 700), ("short", 12)) for t, v in enumerate(series("rising", n))] + [("gap", 0, 1.0), ("gap", 1, None), ("gap", 2, 3.0)]
    got = {r["k"]: r for r in T.mann_kendall(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").collect()}
    for k, n in (("long", 700), ("short", 12)):
        s, slope = pairwise(series("rising", n))
        assert got[k]["s"] == s and math.isclose(got[k]["slope"], slope, rel_tol=1e-9) and got[k]["n"] == n
    assert got["gap"]["n"] == 3 and got["gap"]["s"] is None and got["gap"]["slope"] is None
