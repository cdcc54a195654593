import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.functions import inside
from terrafold.operators import landcover as L
from terrafold.operators import pixels as X
from terrafold.operators import trend as T


def series(values):
    return {k: v[0] for k, v in T.series_trend(np.array([values], float)).items()}


def test_trend_up_equal_and_ties():
    up = series(range(1, 11))
    assert (up["s"], up["var_s"], up["slope"]) == (45, 125, 1) and up["z"] == pytest.approx(44 / math.sqrt(125))
    flat = series([5] * 10)
    assert (flat["s"], flat["z"], flat["p"], flat["slope"]) == (0, 0, 1, 0)
    ties = series([1, 1, 2, 2, 3])
    assert ties["s"] == 8 and ties["var_s"] == pytest.approx((300 - 36) / 18)
    assert series([1])["p"] == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=12))
def test_trend_of_negated_series(values):
    a, b = series(values), series([-v for v in values])
    assert a["s"] == -b["s"] and a["slope"] == -b["slope"] and a["p"] == b["p"]


def test_trend_with_missing_and_absent_values(spark):
    rows = [("up", y, float(y)) for y in range(10)] + [("gap", y, 1.0) for y in range(9)] + [("null", y, None if y == 3 else float(y)) for y in range(10)]
    images = spark.createDataFrame([(10,)], "n_images int").withColumn("month", F.lit("01"))
    px = spark.createDataFrame(rows, "px string, year int, value double").withColumn("month", F.lit("01"))
    out = {r.px: r for r in T.mask_significant(T.mann_kendall(px, ["px", "month"], "year", "value", images)).collect()}
    assert out["up"].s == 45 and out["up"].p < 0.05
    assert out["gap"].s is None and out["gap"].p is None and out["null"].p is None


def test_trend_classes(spark):
    rows = [(0, None, None), (1, None, 0.5), (2, -1.0, 0.1), (2, None, 0.5), (3, 0.0, 0.1), (3, None, 0.5), (4, 1.0, 0.1), (4, None, 0.5), (5, -1.0, 0.1), (5, 1.0, 0.1)]
    out = T.reduce_trend(spark.createDataFrame(rows, "k int, slope double, p double"), ["k"])
    assert all(r.k == r.trend_class for r in out.collect())


def test_overlay(spark):
    coarse = spark.createDataFrame([(0, 0, 2), (0, 1, None), (1, 0, 4)], "row int, col int, trend_class int")
    fine = spark.createDataFrame([(0, 0, 3), (0, 1, 0), (0, 2, 3), (9, 0, 3), (2, 0, 1)], "row int, col int, class_id int")
    geo = {"x0": 0.0, "sx": 1.0, "y0": 4.0, "sy": -1.0}
    out = L.overlay_code(fine, coarse, geo, {"x0": 0.0, "sx": 2.0, "y0": 4.0, "sy": -2.0, "width": 2, "height": 2})
    assert {(r.row, r.col): r.code for r in out.collect()} == {(0, 0): 32, (0, 1): 0, (0, 2): 0, (9, 0): 0, (2, 0): 14}


def test_strict_and_inclusive_edges(spark):
    one = spark.range(1)
    args = F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(2.0)
    assert one.select(inside(*args), inside(*args, inclusive=False)).first()[:2] == (True, False)


def test_stability(spark):
    rows = [(p, y, 1) for p, n in ((0, 19), (1, 20), (2, 35)) for y in range(n)] + [(3, 0, 9)]
    px = spark.createDataFrame(rows, "pixel int, year int, class_id int")
    groups = spark.createDataFrame([("g", 1)], "group string, class_id int")
    assert {r.pixel: r.stable for r in L.class_stability(px, groups, ("pixel",)).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.pixel: r.n_years for r in L.class_stability(px, groups, ("pixel",), include_zero=True).collect()}[3] == 0
    many = spark.range(1001).select(F.col("id").cast("string").alias("group"), F.lit(1).alias("class_id"))
    with pytest.raises(ValueError):
        L.class_stability(px, many, ("pixel",), include_zero=True)


def test_repeated_rows_change_no_years(spark):
    years = [1989, 1990, 1991, 2047, 2048, 2049, 2050, 2051, 2060, -1]
    px = spark.createDataFrame([("p", y, c) for y in years for c in (1, 1, 2)] + [("p", None, 1), ("p", 2070, 9), ("q", 2000, 2)], "pixel string, year int, class_id int")
    groups = spark.createDataFrame([("g", 1), ("g", 2), ("g", 1), ("h", 2)], "group string, class_id int")
    got = {(r["pixel"], r["group"]): (r["n_years"], r["longest_run"], r["stable"]) for r in L.class_stability(px, groups, ("pixel",), min_years=10).collect()}
    assert got == {("p", "g"): (10, 5, 1), ("p", "h"): (10, 5, 1), ("q", "g"): (1, 1, 0), ("q", "h"): (1, 1, 0)}


def test_overlay_deals_unused_pixels_evenly(spark, no_broadcast):
    """Four of five pixels have class 0 or lie outside; the others spread by blocks."""
    at = spark.range(0, 800 * 500, 1, 8).select(F.floor(F.col("id") / 500).cast("int").alias("row"), (F.col("id") % 500).cast("int").alias("col"))
    fine = at.withColumn("class_id", F.when(F.col("col") % 5 == 0, 3).when(F.col("col") % 5 == 1, None).otherwise(0))
    coarse = spark.range(62 * 62).select(F.floor(F.col("id") / 62).cast("int").alias("row"), (F.col("id") % 62).cast("int").alias("col")).withColumn("trend_class", (F.col("row") + F.col("col")) % 6)
    geo = {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": -1.0}
    out = L.overlay_code(fine, coarse, geo, {"x0": 0.0, "sx": 8.0, "y0": 0.0, "sy": -8.0, "width": 62, "height": 62})
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) <= 2 * 400_000 / 8
    met = [r["count"] for r in out.where("col % 5 = 0 and row < 496 and col < 496").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(met) <= 2 * sum(met) / 8
    wrong = out.where("col % 5 = 0 and row < 496 and col < 496").where("code <> if((row div 8 + col div 8) % 6 = 0, 0, 30 + (row div 8 + col div 8) % 6)")
    assert wrong.count() == 0 and out.where("(col % 5 <> 0 or row >= 496 or col >= 496) and code <> 0").count() == 0


def test_blocks_hold_about_as_many_pixels_whatever_the_grids(spark):
    at = lambda sx: {"sx": sx, "sy": -sx}
    assert [L.block_side(at(1.0), at(c)) for c in (0.5, 1.0, 8.0, 30.0, 1000.0)] == [64, 64, 8, 2, 1]


def test_valid_pixels_and_nodata(spark):
    px = spark.createDataFrame([(1, -9.0), (1, 2.0), (None, 2.0), (1, float("nan"))], "a int, b double")
    assert [tuple(r) for r in X.valid_pixels(px, {"a": None, "b": -9.5}).where("a = 1 and not isnan(b)").collect()] == [(1, 2.0)]
    assert [r.b for r in X.nodata_to_null(px, "b", -9.0).collect()] == [None, 2.0, 2.0, None]


def test_describe(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 4, 9)], "name string, v double")
    r = X.describe_area(df, "name", ("v",)).first()
    assert (r.n, r.mean, r.q25, r.q50, r.q75, r.area) == (4, 4.0, 1.75, 3.0, 5.25, 3600.0)


def test_describe_bands(spark):
    rows = [("f", 1, 5), ("f", 3, None), ("f", None, 7), ("g", None, None)]
    df = spark.createDataFrame(rows, "name string, a int, b int")
    for accuracy in (None, 1000):
        got = {(r.name, r.band): r for r in X.describe_area(df, "name", ("a", "b"), accuracy=accuracy).collect()}
        assert [(got["f", b].n, got["f", b].min, got["f", b].max, got["f", b].area) for b in "ab"] == [(2, 1, 3, 1800), (2, 5, 7, 1800)]
        assert got["g", "a"].n == 0 and got["g", "b"].mean is None and got["g", "b"].area == 0
    assert X.describe_area(df.limit(0), "name", ("a",)).count() == 0


def test_snap_of_an_aligned_extent(spark):
    ext = spark.createDataFrame([(0.25, 1.0, 0.5, 2.0)], "minx double, maxx double, miny double, maxy double")
    r = X.snap_extent(ext, 0.0, 0.25, 5.0, -0.25).first()
    assert (r.left, r.right, r.top, r.bottom) == (0.25, 1.25, 2.0, 0.25)


def test_unflatten(spark):
    flat = spark.createDataFrame([(i, float(i), 90.0, 0.0, 90.0, 90.0) for i in range(15)], "pos int, height double, north double, west double, n_s double, e_w double")
    out = X.unflatten_grid(flat, 5).collect()
    assert len(out) == 12 and {r.lon for r in out} == {0.0, 90.0, 180.0, -90.0} and {r.lat for r in out} == {90.0, 0.0, -90.0}


def test_unflatten_by_the_header(spark):
    flat = spark.createDataFrame([(i, float(i), 90.0, 0.0, 360.0, 90.0, 90.0) for i in range(15)], "pos int, height double, north double, west double, east double, n_s double, e_w double")
    assert sorted(map(tuple, X.unflatten_grid(flat).collect())) == sorted(map(tuple, X.unflatten_grid(flat, 5).collect()))


def test_extent_of_a_rotated_image(spark):
    catalog = spark.createDataFrame([("r", 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 3, 2)], "raster_id string, x0 double, sx double, rx double, y0 double, ry double, sy double, width int, height int")
    points = spark.createDataFrame([(1, 1.5, 2.5), (2, 2.5, 1.5)], "point_id int, x double, y double")
    pixels = spark.createDataFrame([("r", 1, 2, 7.0)], "raster_id string, row int, col int, value double")
    assert [tuple(r) for r in X.sample_at_points(points, catalog, pixels).collect()] == [(1, "r", 7.0)]


def test_points_in_extents_equals_the_plain_join(spark):
    points = spark.range(60).select(F.col("id").alias("point_id"), (F.col("id") % 8 * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    catalog = spark.createDataFrame([(str(i), float(i), 1.0, 0.0, i + 2.0, 0.0, -1.0, 3, 2) for i in range(5)], "raster_id string, x0 double, sx double, rx double, y0 double, ry double, sy double, width int, height int")
    got = X.points_in_extents(points, catalog).select("point_id", "raster_id")
    plain = points.join(catalog, F.expr("x between x0 and x0 + width and y between y0 - height and y0")).select("point_id", "raster_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
