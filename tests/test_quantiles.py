"""Exact quantiles against numpy on values that are hard to cut: ties, all magnitudes, signs, special values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import pixels as X
from terrafold.operators.quantiles import exact_quantiles, order_key

PLACES = (0.0, 0.25, 0.5, 0.9, 1.0)


def groups() -> dict:
    rng = random.Random(4)
    wide = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-320, 300) for _ in range(3000)]
    return {
        "ties": [float(rng.randint(0, 3)) for _ in range(1000)],
        "one": [7.5],
        "two": [1.0, 2.0],
        "wide": wide,
        "close": [1.0 + i * 2.0**-52 for i in rng.sample(range(5000), 2000)],
        "tiny": [i * 5e-324 for i in range(90, 900)],
        "infinite": [math.inf, -math.inf, 1.0, 2.0, math.inf],
        "zeros": [0.0, -0.0, 0.0, -1.0],
        None: [3.0, 1.0, 2.0, 9.0],
    }


@pytest.mark.parametrize("small", [1 << 16, 40, 1])
def test_equals_numpy(spark, small):
    rows = [(k, v, "x") for k, values in groups().items() for v in values] + [("ties", None, "x"), ("nothing", None, "x")]
    df = spark.createDataFrame(rows, "k string, value double, v string").repartition(5)
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "value", PLACES, small).collect()}
    assert set(got) == set(groups())
    for k, values in groups().items():
        with np.errstate(invalid="ignore"):
            ordered, n = sorted(values), len(values) - 1
            want = [ordered[int(p * n)] if p * n == int(p * n) else ordered[int(p * n)] + (ordered[int(p * n) + 1] - ordered[int(p * n)]) * (p * n - int(p * n)) for p in PLACES]
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[k], want, strict=True)), k


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, math.inf), (1, 5.0)], "k int, v double")
    low, middle, high = exact_quantiles(df, ["k"], "v", (0.0, 0.5, 1.0)).first()["quantiles"]
    assert low == 5.0 and middle == math.inf and math.isnan(high)


def test_order_key_never_falls(spark):
    values = sorted(v for vs in groups().values() for v in vs) + [math.inf, math.nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", order_key(F.col("v")).alias("k"))
    keys = [r["k"] for r in df.orderBy("i").collect()]
    assert keys == sorted(keys)


def test_several_keys_and_no_rows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), F.col("id").alias("v"))
    got = {(r["a"], r["key"]): r["quantiles"][0] for r in exact_quantiles(df, ["a", "key"], "v", (0.5,)).collect()}
    want = {(a, b or None): float(np.median([i for i in range(1000) if i % 2 == a and i % 3 == b])) for a in (0, 1) for b in (0, 1, 2)}
    assert got == want
    assert exact_quantiles(df.limit(0), ["a", "key"], "v", (0.5,)).count() == 0


def test_describe_with_null_groups_and_exact_or_near_quartiles(spark):
    rows = [("a", float(i), None if i % 4 else 1.0) for i in range(101)] + [(None, 5.0, 2.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "name string, x double, y double")
    for accuracy in (None, 10_000):
        got = {(r["name"], r["band"]): r for r in X.describe_area(df, "name", ("x", "y"), accuracy=accuracy).collect()}
        assert len(got) == 6
        r = got["a", "x"]
        assert (r["n"], r["q25"], r["q50"], r["q75"], r["area"]) == (101, 25.0, 50.0, 75.0, 101 * 900.0)
        assert (got[None, "y"]["q50"], got["a", "y"]["n"], got["none", "x"]["q50"], got["none", "x"]["n"]) == (2.0, 26, None, 0)
