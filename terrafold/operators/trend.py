"""Mann-Kendall trends with Sen slopes, and their reduction over months."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "n int, s double, var_s double, z double, p double, slope double"
#: Differences between values of series that are held at once.
CHUNK = 1 << 21
#: Series of more values are never compared pair by pair.
PAIRWISE = 512
#: Slopes that are listed to pick the median from; others are counted only.
LISTED = 1 << 18


def _merges(order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The steps of a merge sort of a permutation, from the bottom: for each step, the positions of the right halves' elements,
    and the range of those elements of their left halves, all of these put together in ascending order, that are greater."""
    n, width = len(order), 1
    at = np.arange(n)
    while width < n:
        pair = at // (2 * width)
        merged = np.argsort(pair * n + order, kind="stable")
        left = (merged // width) % 2 == 0
        lefts = merged[left]
        before = np.cumsum(left)
        # Past the last left element of the same pair of halves.
        end = np.searchsorted(lefts // (2 * width), pair[merged[~left]], side="right")
        yield lefts, merged[~left], np.stack([before[~left], end])
        width *= 2


def inversions(order: np.ndarray) -> int:
    """Pairs of a permutation that are out of order, in n log n steps and memory of the order of n."""
    return sum(int((span[1] - span[0]).sum()) for _, _, span in _merges(order))


def _inverted(order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of up to `most` pairs that are out of order."""
    found, n = [], 0
    for lefts, right, (a, b) in _merges(order):
        count = b - a
        if n + count.sum() > most:
            keep = np.flatnonzero(np.cumsum(count) <= most - n)
            right, a, count = right[keep], a[keep], count[keep]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append((lefts[np.repeat(a, count) + place], np.repeat(right, count)))
        n += len(place)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ranks(x: np.ndarray, falling: bool = False) -> np.ndarray:
    """Places of values in ascending order; equal ones keep their order, or turn it around."""
    order = np.argsort(x, kind="stable") if not falling else len(x) - 1 - np.argsort(x[::-1], kind="stable")
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x))
    return out


def median_slope(x: np.ndarray) -> float:
    """The median of (x[j] - x[i]) / (j - i) over i < j, without listing all of them.

    Two values are out of order after a line of slope t is taken from the series just where their slope is less than t, so
    slopes below t are counted as inversions. The interval around the wanted ranks is narrowed until few slopes lie in it,
    which are then listed; or until it is so narrow that all slopes in it are one value, but for rounding.
    """
    n, at = len(x), np.arange(len(x))
    total = n * (n - 1) // 2
    wanted = ((total - 1) // 2, total // 2)
    rank = lambda t: _ranks(x - t * at)
    step = float(np.abs(np.diff(x)).max())
    if step == 0:
        return 0.0
    noise = 1e-14 * (float(np.abs(x - x[0]).max()) + step)
    low, high, below, upto = -2 * step, 2 * step, 0, total
    pick = np.random.default_rng(n)
    i, j = pick.integers(0, n, (2, 1 << 12))
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    sample = np.sort((x[j] - x[i]) / (j - i))
    # A guess on each side of the median at first; halves after that.
    guesses = [sample[int(len(sample) * q)] + s for q, s in ((0.45, -noise), (0.55, noise))]
    while upto - below > LISTED and high - low > 4 * noise:
        t = guesses.pop(0) if guesses else (low + high) / 2
        if not low < t < high:
            if guesses:
                continue
            break
        count = inversions(rank(t))
        if count <= wanted[0]:
            low, below = t, count
        elif count > wanted[1]:
            high, upto = t, count
        else:
            # The two middle slopes lie on both sides of t.
            return (_slope_at(x, low, t, below, wanted[0], noise) + _slope_at(x, t, high, count, wanted[1], noise)) / 2
    a, b = (_slope_at(x, low, high, below, w, noise) for w in wanted)
    return (a + b) / 2


def _slope_at(x: np.ndarray, low: float, high: float, below: int, wanted: int, noise: float) -> float:
    """The slope of a rank among those from low to high, of which `below` are less than low."""
    at = np.arange(len(x))
    first = np.argsort(x - low * at, kind="stable")
    # In the order at low, pairs whose slope is in between are out of order at high.
    order = _ranks(x - high * at)[first]
    count = inversions(order)
    if count > LISTED and high - low > 4 * noise:
        middle = (low + high) / 2
        upto = inversions(_ranks(x - middle * at))
        return _slope_at(x, low, middle, below, wanted, noise) if wanted < upto else _slope_at(x, middle, high, upto, wanted, noise)
    i, j = (first[k] for k in _inverted(order, LISTED))
    slopes = np.sort((x[j] - x[i]) / (j - i))
    # More slopes than are listed are equal but for rounding.
    return float(slopes[min(wanted - below, len(slopes) - 1)])


def series_trend(x: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of equally long series, one a row, in time order. Short ones are compared pair by pair, all at once; a
    longer one costs n log n steps and memory in proportion to n."""
    n = x.shape[1]
    if n < 2:
        zero = np.zeros(len(x))
        return {"s": zero, "var_s": zero, "z": zero, "p": zero + 1, "slope": zero * np.nan}
    if n <= PAIRWISE:
        i, j = np.triu_indices(n, 1)
        d = x[:, j] - x[:, i]
        s, slope = np.sign(d).sum(1), np.median(d / (j - i), axis=1)
    else:
        s = np.array([float(inversions(_ranks(-v)) - inversions(_ranks(v))) for v in x])
        slope = np.array([median_slope(v) for v in x])
    var = np.array([n * (n - 1) * (2 * n + 5) - int(((k := np.unique(v, return_counts=True)[1]) * (k - 1) * (2 * k + 5)).sum()) for v in x]) / 18
    z = np.where(var > 0, (s - np.sign(s)) / np.sqrt(np.where(var > 0, var, 1)), 0.0)
    p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
    return {"s": s, "var_s": var, "z": z, "p": p, "slope": slope}


def mann_kendall(px: DataFrame, keys: list[str], t: str, v: str, images: DataFrame | None = None) -> DataFrame:
    """keys with n, s, var_s, z, p, slope of the series of v by t. Time counts as the place in the series.

    images: (some of keys, n_images); a series with a missing or absent value has nulls but for n. A series is one
    value an image, so its array is small.
    """
    series = px.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).cast("double").alias("v")))).alias("series"))
    if images is None:
        series = series.withColumn("n_images", F.size("series"))
    else:
        series = series.join(images, [c for c in images.columns if c != "n_images"])
    whole = (F.size("series") == F.col("n_images")) & F.forall("series", lambda e: e["v"].isNotNull() & ~F.isnan(e["v"]))
    values = F.when(whole, F.transform("series", lambda e: e["v"]))

    @F.pandas_udf(RESULT)
    def trend(arrays: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=range(len(arrays)), columns=["n", "s", "var_s", "z", "p", "slope"])
        n = np.array([-1 if a is None else len(a) for a in arrays])
        for size in sorted(set(n[n > 0].tolist())):
            rows = np.flatnonzero(n == size)
            step = max(1, CHUNK // min(size, PAIRWISE) ** 2)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for c, got in series_trend(np.stack([arrays.iloc[r] for r in part])).items():
                    out.loc[part, c] = got
        out["n"] = pd.array(np.where(n < 0, 0, n), dtype="int32")
        return out.astype(object).where(out.notna(), None).astype({"n": "int32"} | dict.fromkeys(["s", "var_s", "z", "p", "slope"], "Float64"))

    return series.select(*keys, F.size("series").alias("n"), trend(values).alias("m")).select(*keys, "n", *[f"m.{c}" for c in ("s", "var_s", "z", "p", "slope")])


def mask_significant(df: DataFrame, p_sig: float = 0.05) -> DataFrame:
    """s and slope only where p is at most p_sig; p stays."""
    return df.withColumns({c: F.when(F.col("p") <= p_sig, F.col(c)) for c in ("s", "slope")})


def reduce_trend(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """One class over months: 0 no data, 1 no significant slope, 2 all falling, 3 all level, 4 all rising, 5 mixed."""
    slope = F.col("slope")
    n = monthly.groupBy(*keys).agg(
        F.count("slope").alias("n"), F.count("p").alias("n_p"), *[F.count_if(c).alias(a) for a, c in (("falling", slope < 0), ("level", slope == 0), ("rising", slope > 0))]
    )
    kind = F.when(F.col("n_p") + F.col("n") == 0, 0).when(F.col("n") == 0, 1)
    for k, c in ((2, "falling"), (3, "level"), (4, "rising")):
        kind = kind.when(F.col(c) == F.col("n"), k)
    return n.select(*keys, kind.otherwise(5).cast("int").alias("trend_class"))
