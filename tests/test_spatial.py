"""Points in boxes by a quadtree, against comparing all with all; dense places, huge boxes, edges."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import spatial
from terrafold.operators.spatial import DEPTH, leaf_boxes, points_in_boxes, quadtree, z_cell

BOXES = "name string, minx double, maxx double, miny double, maxy double"


def boxes_of(rng: random.Random) -> list:
    out = [("world", -180.0, 180.0, -90.0, 90.0), ("line", 5.0, 5.0, -10.0, 10.0), ("dot", 7.5, 7.5, 7.5, 7.5), ("null", None, 1.0, 0.0, 1.0), ("nan", float("nan"), 1.0, 0.0, 1.0), ("turned", 3.0, 1.0, 0.0, 1.0)]
    for i in range(60):
        x, y, w, h = rng.uniform(-180, 170), rng.uniform(-90, 80), rng.choice([0.01, 1, 30]), rng.choice([0.01, 1, 30])
        out.append((f"b{i}", x, x + w, y, y + h))
    return out


def points_of(rng: random.Random, n: int) -> list:
    """A third in one place, a third in one town, the rest anywhere, also on corners and outside."""
    out = [(i, 12.25, 41.75) for i in range(n // 3)] + [(n + i, 12 + rng.random() / 50, 41 + rng.random() / 50) for i in range(n // 3)]
    out += [(2 * n + i, rng.uniform(-200, 200), rng.uniform(-100, 100)) for i in range(n // 3)]
    return [*out, (-1, -180.0, -90.0), (-2, 180.0, 90.0), (-3, 7.5, 7.5), (-4, 5.0, 10.0), (-5, None, 1.0), (-6, 1.0, None), (-7, float("nan"), 1.0), (-8, 180.0001, 0.0), (-3, 7.5, 7.5)]


@pytest.mark.parametrize("least", [1, 20, 10_000])
def test_equals_comparing_all(spark, least):
    rng = random.Random(least)
    points, boxes = points_of(rng, 300), boxes_of(rng)
    got = points_in_boxes(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(boxes, BOXES), least)
    assert got.columns == ["point_id", "x", "y", "name", "minx", "maxx", "miny", "maxy"]
    want = [(i, n) for i, x, y in points for n, a, b, c, d in boxes if None not in (x, y, a, b, c, d) and a <= x <= b and c <= y <= d]
    assert sorted((r["point_id"], r["name"]) for r in got.collect()) == sorted(want)


def test_nothing_and_clashing_names(spark):
    points, boxes = spark.createDataFrame([(1, 1.0, 1.0)], "point_id int, x double, y double"), spark.createDataFrame([("a", 0.0, 2.0, 0.0, 2.0)], BOXES)
    assert points_in_boxes(points, boxes.limit(0)).count() == points_in_boxes(points.limit(0), boxes).count() == 0
    assert points_in_boxes(points, boxes).count() == 1
    with pytest.raises(ValueError):
        points_in_boxes(points.withColumn("NAME", F.lit(1)), boxes)


def test_leaves_cover_each_cell_once(spark):
    rng = random.Random(8)
    cells = [(rng.randrange(4**DEPTH), 1) for _ in range(3000)] + [(77, 5000), (4**DEPTH - 1, 3)]
    df = spark.createDataFrame(cells, "z long, n long").groupBy("z").agg(F.sum("n").alias("n"))
    leaves = quadtree(df, 50)
    x1, x2, y1, y2 = leaf_boxes(leaves)
    assert leaves["n"].sum() == sum(n for _, n in cells)
    limit = max(50, -(-leaves["n"].sum() // spatial.LEAVES))
    assert all((n <= limit) or level == DEPTH for n, level in zip(leaves["n"], leaves["level"], strict=True))
    assert leaves.loc[leaves["level"] == DEPTH, "parts"].max() == -(-5000 // limit)
    size = 4 ** (DEPTH - leaves["level"])
    assert (leaves["first"] + size <= leaves["first"].shift(-1, fill_value=4**DEPTH)).all()
    assert ((x2 - x1 + 1) ** 2 == size).all() and ((y2 - y1) == (x2 - x1)).all()


def test_leaves_of_large_tables_are_dealt_out(spark, monkeypatch):
    """However much a leaf may hold, a part holds HEAVY at most."""
    monkeypatch.setattr(spatial, "HEAVY", 40)
    leaves = quadtree(spark.createDataFrame([(i * 7919 % 4**DEPTH, 9) for i in range(500)], "z long, n long"), 1000)
    assert (leaves["n"] > 40).any() and (leaves["parts"] == -(-leaves["n"] // 40)).all()
    rng = random.Random(2)
    points, boxes = points_of(rng, 300), boxes_of(rng)
    got = points_in_boxes(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(boxes, BOXES), 10_000)
    want = [(i, n) for i, x, y in points for n, a, b, c, d in boxes if None not in (x, y, a, b, c, d) and a <= x <= b and c <= y <= d]
    assert sorted((r["point_id"], r["name"]) for r in got.collect()) == sorted(want)


def test_cells_follow_z_order(spark):
    rows = [(i, j, (i + 0.5) / 2**DEPTH, (j + 0.5) / 2**DEPTH) for i, j in ((0, 0), (1, 0), (0, 1), (5, 9), (2**DEPTH - 1, 2**DEPTH - 1))]
    df = spark.createDataFrame(rows, "i int, j int, x double, y double")
    interleaved = lambda i, j: sum((i >> b & 1) << 2 * b | (j >> b & 1) << 2 * b + 1 for b in range(DEPTH))
    got = df.select("i", "j", z_cell(F.col("x"), F.col("y"), (0.0, 1.0, 0.0, 1.0)).alias("z")).collect()
    assert all(r["z"] == interleaved(r["i"], r["j"]) for r in got)


@pytest.mark.parametrize("place", ["x = 12.25 and y = 41.75", "x between 12 and 12.0001"])
def test_a_dense_place_stays_balanced(spark, no_broadcast, place):
    """Nine of ten points are in one finest cell; the pairs spread over all tasks."""
    n = 40_000
    dense = F.col("id") % 10 > 0
    wide = 0.0 if "=" in place.split()[1] else 0.0001
    points = spark.range(n).select(F.col("id").alias("point_id"), F.when(dense, 12.25 if not wide else 12 + F.rand(1) * wide).otherwise(F.rand(2) * 300 - 150).alias("x"), F.when(dense, 41.75).otherwise(F.rand(3) * 160 - 80).alias("y"))
    boxes = spark.createDataFrame([("world", -180.0, 180.0, -90.0, 90.0), ("town", 12.0, 13.0, 41.0, 42.0), *((f"far{i}", -100.0 + i, -99.0 + i, 0.0, 1.0) for i in range(50))], BOXES)
    got = points_in_boxes(points, boxes)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) >= n + 0.9 * n and len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8
