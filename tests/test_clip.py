"""Clipping by scan lines and tiles against the even-odd test of each pixel centre."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import clip
from terrafold.operators.clip import RINGS, TILE, clip_to_regions, region_tiles, scan_lines

GRID = {"x0": -3.0, "sx": 0.5, "y0": 100.0, "sy": -0.5}


def inside(x: float, y: float, rings: list) -> bool:
    out = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                out = not out
    return out


def expected(regions: list, height: int, width: int, grid: dict) -> list:
    x, y = lambda c: grid["x0"] + (c + 0.5) * grid["sx"], lambda r: grid["y0"] + (r + 0.5) * grid["sy"]
    return sorted((name, r, c) for name, rings in regions for r in range(height) for c in range(width) if inside(x(c), y(r), rings or []))


def raster(spark, height: int, width: int):
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), F.lit("own").alias("mask"), F.lit(0).alias("tile_row"))


def polygons(seed: int) -> list:
    """Self-crossing and concave rings, corners on pixel centres and on edges, a ring within a ring, nothing at all."""
    rng = random.Random(seed)
    at = lambda: (rng.randint(-20, 220) / 4, 100 - rng.randint(-20, 220) / 4)
    out = [(f"p{i}", [[at() for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 3))]) for i in range(6)]
    box = lambda a, b, c, d: [(float(a), 100.0 - b), (float(c), 100.0 - b), (float(c), 100.0 - d), (float(a), 100.0 - d)]
    out += [("box", [box(-10, -10, 90, 90)]), ("hole", [box(0, 1, 60, 60), box(5.25, 5.25, 50.25, 48)]), ("row", [box(0, 10, 60, 10.5)]), ("centre", [box(0.25, 0.25, 20.25, 20.25)])]
    return [*out, ("flat", [[(0.0, 50.0), (9.0, 50.0)]]), ("point", [[(1.0, 50.0)]]), ("empty", [[]]), ("none", []), ("null", None)]


@pytest.mark.parametrize("seed, grid", [(1, GRID), (2, {**GRID, "y0": 40.0, "sy": 0.5}), (3, {**GRID, "width": 150, "height": 140}), (4, {"x0": 0.1, "sx": 0.3, "y0": 99.7, "sy": -0.7})])
def test_clip_equals_the_even_odd_test(spark, seed, grid):
    regions = polygons(seed)
    df = spark.createDataFrame(regions, f"region_id string, rings {RINGS}")
    got = clip_to_regions(raster(spark, 140, 150), df, grid)
    assert got.columns == ["row", "col", "mask", "tile_row", "region_id"]
    assert sorted((r["region_id"], r["row"], r["col"]) for r in got.collect()) == expected(regions, 140, 150, grid)


def test_a_ring_by_itself_and_closed(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    grid = {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": 1.0}
    for corners in (ring, [*ring, ring[0]]):
        df = spark.createDataFrame([("r", corners), ("n", None)], "region_id string, ring array<struct<x: double, y: double>>")
        got = clip_to_regions(raster(spark, 5, 5), df, grid).collect()
        assert sorted(("r", r["row"], r["col"]) for r in got) == expected([("r", [ring])], 5, 5, grid)


def test_wholly_inside_tiles_have_no_mask(spark):
    """A square of 10 by 10 tiles that starts in the middle of one: 9 by 9 tiles are decided once, the rest is border."""
    side, half = 10 * TILE, TILE // 2
    ring = [(half, half), (half + side, half), (half + side, half + side), (half, half + side)]
    df = spark.createDataFrame([("s", [[(float(x), float(y)) for x, y in ring]])], f"region_id string, rings {RINGS}")
    spans = scan_lines(df, {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": 1.0})
    assert spans.count() == side
    tiles = region_tiles(spans).collect()
    assert len({(t["tile_row"], t["tile_col"]) for t in tiles}) == len(tiles) == 11 * 11
    assert sum(t["mask"] is None for t in tiles) == 9 * 9
    assert sum(bin(m & (2**64 - 1)).count("1") for t in tiles if t["mask"] for m in t["mask"]) + 81 * TILE**2 == side**2


def test_no_ring_beside_a_pixel(spark):
    """What is joined to pixels is a key and a mask; the plan of the pixel side has no ring."""
    df = spark.createDataFrame(polygons(5), f"region_id string, rings {RINGS}")
    assert region_tiles(scan_lines(df, GRID)).columns == ["region_id", "tile_row", "tile_col", "mask"]
    got = clip_to_regions(raster(spark, 4, 4).withColumn("row", F.lit(None).cast("int")), df, GRID)
    assert got.count() == 0


@pytest.mark.parametrize("wrong", [{"sx": -1.0}, {"sx": 0.0}, {"sy": 0.0}])
def test_grids_that_cannot_be_scanned(spark, wrong):
    df = spark.createDataFrame([], f"region_id string, rings {RINGS}")
    with pytest.raises(ValueError):
        clip.scan_lines(df, GRID | wrong)
