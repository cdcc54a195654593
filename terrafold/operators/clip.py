"""Clipping pixels by polygons: scan lines over a raster's rows, then tiles of 64 by 64 pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"
RINGS = f"array<{RING}>"
#: Rows and columns of a tile; a row of a tile is one 64-bit mask.
TILE = 64


def _div(c: Column, n: int = TILE) -> Column:
    return F.floor(c / n).cast("int")


def _first_column(x: Column, x0: float, sx: float) -> Column:
    """The first column whose centre isn't left of x, by the same arithmetic as that of a centre."""
    at = F.ceil((x - x0) / sx - 0.5)
    centre = lambda c: F.lit(x0) + (c + 0.5) * F.lit(sx)
    return F.when(centre(at - 1) >= x, at - 1).when(centre(at) < x, at + 1).otherwise(at).cast("int")


def scan_lines(regions: DataFrame, grid: dict[str, float]) -> DataFrame:
    """region_id, row, lo, hi: the columns lo to hi (both included) of a raster row whose centres lie in a region.

    regions: region_id and `rings`, an array of rings, or `ring`, one of them; a ring is an array of corners (x, y), closed
    or not. A centre is inside where a line to its right crosses the edges of all rings together an odd number of times, so
    a ring within another is a hole. A null ring has no edges. grid: x0, sx, y0, sy, sx above 0; with width and height,
    what lies outside the raster is left out. Every edge is its own row, so a ring of any length is spread.
    """
    x0, sx, y0, sy = (float(grid[k]) for k in ("x0", "sx", "y0", "sy"))
    if sx <= 0 or sy == 0:
        raise ValueError("a grid needs sx above 0 and sy other than 0")
    if "rings" in regions.columns:
        rings = regions.select("region_id", F.explode("rings").alias("ring"))
    else:
        rings = regions.select("region_id", "ring")
    n = F.size("ring")
    corner = lambda i: F.get(F.col("ring"), i)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(corner(i).alias("a"), corner((i + 1) % n).alias("b")))
    e = rings.where(n > 0).select("region_id", F.explode(edges).alias("e")).select("region_id", *[F.col(f"e.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    at = lambda y: (y - y0) / sy - 0.5
    first, last = F.floor(F.least(at(low), at(high))), F.ceil(F.greatest(at(low), at(high)))
    if "height" in grid:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(int(grid["height"]) - 1))
    rows = e.where((low < high) & (first <= last)).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    y = F.lit(y0) + (F.col("row") + 0.5) * F.lit(sy)
    x = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    crossing = rows.where((low <= y) & (y < high)).select("region_id", "row", x.alias("x"))
    along = Window.partitionBy("region_id", "row").orderBy("x")
    pairs = crossing.select("region_id", "row", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("i")).where("i % 2 = 1")
    lo, hi = _first_column(F.col("x"), x0, sx), _first_column(F.col("to"), x0, sx) - 1
    if "width" in grid:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(int(grid["width"]) - 1))
    return pairs.select("region_id", "row", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")


def region_tiles(spans: DataFrame) -> DataFrame:
    """region_id, tile_row, tile_col, mask of the tiles that a region touches: mask is null for a tile that lies wholly inside,
    else an array with 64 bits a row. Tiles outside are in no row.

    Ends of spans, summed along a row of tiles, tell how many of its 64 rows cover a tile; runs of tiles that all rows
    cover are told once, so the inside of a region is never spread by pixel rows. Only tiles on a border get masks.
    """
    row, lo, hi = F.col("row"), F.col("lo"), F.col("hi")
    s = spans.withColumns({"tile_row": _div(row), "r": (row - TILE * _div(row)).cast("int"), "t_lo": _div(lo), "t_hi": _div(hi), "from": F.ceil(lo / TILE).cast("int"), "to": _div(hi + 1)})
    line = ["region_id", "tile_row"]
    ends = F.explode(F.array(F.struct(F.col("from").alias("t"), F.lit(1).alias("step")), F.struct(F.col("to").alias("t"), F.lit(-1).alias("step"))))
    steps = s.where(F.col("from") < F.col("to")).select(*line, ends.alias("e")).groupBy(*line, "e.t").agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy(*line).orderBy("t")
    runs = steps.select(*line, "t", F.sum("step").over(along).alias("cover"), F.lead("t").over(along).alias("end")).where("cover > 0")
    tiles = F.explode(F.sequence("t", F.col("end") - 1)).alias("tile_col")
    whole = runs.where(F.col("cover") == TILE).select(*line, tiles, F.lit(None).cast("array<bigint>").alias("mask"))
    # The columns of a span in the tiles where it ends, as bits.
    first = F.when(F.col("t_lo") == F.col("t_hi"), hi - TILE * F.col("t_hi")).otherwise(TILE - 1)
    ends = s.select(*line, "r", F.explode(F.array(
        F.struct(F.col("t_lo").alias("tile_col"), (lo - TILE * F.col("t_lo")).alias("a"), first.alias("b")),
        F.struct(F.col("t_hi").alias("tile_col"), F.when(F.col("t_lo") == F.col("t_hi"), lo - TILE * F.col("t_lo")).otherwise(0).alias("a"), (hi - TILE * F.col("t_hi")).alias("b")),
    )).alias("e")).select(*line, "r", "e.*").where((F.col("a") > 0) | (F.col("b") < TILE - 1))
    # The tiles that a span covers but not all other rows do.
    broken = runs.where(F.col("cover") < TILE).select(*line, F.col("t").alias("t1"), F.col("end").alias("t2"))
    part = s.where(F.col("from") < F.col("to")).join(broken, line).where((F.col("from") < F.col("t2")) & (F.col("t1") < F.col("to")))
    inner = part.select(*line, "r", F.explode(F.sequence(F.greatest("from", "t1"), F.least("to", "t2") - 1)).alias("tile_col"), F.lit(0).alias("a"), F.lit(TILE - 1).alias("b"))
    ones = F.lit(-1).cast("long")
    bits = F.call_function("shiftleft", ones, F.col("a")).bitwiseAND(F.call_function("shiftrightunsigned", ones, TILE - 1 - F.col("b")))
    masks = ends.unionByName(inner).groupBy(*line, "tile_col", "r").agg(F.bit_or(bits).alias("bits"))
    by_row = masks.groupBy(*line, "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("r", "bits"))).alias("by_row"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda i: F.coalesce(F.element_at("by_row", i), F.lit(0).cast("long")))
    return whole.unionByName(by_row.select(*line, "tile_col", mask.alias("mask")))


def clip_to_regions(px: DataFrame, regions: DataFrame, grid: dict[str, float]) -> DataFrame:
    """px (with row and col on the grid) of the pixels whose centre lies in a region, once for each region_id.

    Pixels meet the tiles of the regions by their tile alone: one wholly inside decides for all its pixels, one on a border
    brings 512 bytes of mask, whatever the length of the border. Pixels without row or col are in no region.
    """
    name = lambda c: next(n for n in (c + "_" * i for i in range(len(px.columns) + 1)) if n not in px.columns)
    r, c, mask = name("tile_row"), name("tile_col"), name("mask")
    tiles = region_tiles(scan_lines(regions, grid)).withColumnsRenamed({"tile_row": r, "tile_col": c, "mask": mask})
    at = px.withColumns({r: _div(F.col("row")), c: _div(F.col("col"))})
    own = F.get(F.col(mask), F.col("row") - TILE * F.col(r))
    bit = F.call_function("shiftrightunsigned", own, (F.col("col") - TILE * F.col(c)).cast("int")).bitwiseAND(F.lit(1))
    return at.join(tiles, [r, c]).where(F.col(mask).isNull() | (bit == 1)).select(*px.columns, "region_id")
