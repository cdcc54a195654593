"""Rasters as pixel tables: validity, masks, stacks, sampling, extents and summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_mod, raster_extent, world_to_pixel
from .quantiles import exact_quantiles
from .spatial import points_in_boxes


def nodata_to_null(px: DataFrame, column: str, nodata: float | None) -> DataFrame:
    """Nodata and NaN as null; NaN would poison sums and compare as the largest value."""
    c = F.col(column)
    good = c.isNotNull() & ~F.isnan(c.cast("double"))
    return px.withColumn(column, F.when(good if nodata is None else good & (c != nodata), c))


def valid_pixels(px: DataFrame, nodata: dict[str, float | None]) -> DataFrame:
    """Pixels of which no band is null or its nodata (cut to a whole number); a band without one is always valid."""
    tests = [F.col(b).isNotNull() & (F.col(b) != int(n)) for b, n in nodata.items() if n is not None]
    return px.where(reduce(and_, tests)) if tests else px


#: Classes of cropland. Fixed values.
CROPS = (20, 36, 39, 41)


def mask_by_class(px: DataFrame, value: str, class_col: str, ids: tuple[int, ...] = CROPS) -> DataFrame:
    """value where the class is one of ids, else null."""
    return px.withColumn(value, F.when(F.col(class_col).isin(*ids), F.col(value)))


def stack_bands(px: DataFrame, bands: tuple[int, ...], keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """One row a pixel with a column a band; the bands are given, so the pivot needs no pass to find them."""
    return px.groupBy(*keys).pivot("band", list(bands)).agg(F.first("value")).select(*keys, *[F.col(str(b)).alias(f"band{b}") for b in bands])


def describe_area(df: DataFrame, by: str, columns: tuple[str, ...], pixel_area: float = 900.0, accuracy: int | None = None) -> DataFrame:
    """by, band, n, mean, std, min, q25, q50, q75, max, area: a row for each group and column. The area is that of the pixels
    which have a value in the first column. A null group is a group.

    Quartiles are exact and come from histograms, so a group's values are never in one place; with an accuracy they are
    approximate and cost no further pass (1 / accuracy is their relative error in rank).
    """
    places = (0.25, 0.5, 0.75)
    facts = lambda c: (("n", F.count(c)), ("mean", F.avg(c)), ("std", F.stddev(c)), ("min", F.min(c)), ("max", F.max(c)))
    near = lambda c: [F.percentile_approx(c, list(places), accuracy).cast("array<double>").alias("q")] if accuracy else []
    of = lambda c: F.struct(F.lit(c).alias("band"), *[v.cast("long" if n == "n" else "double").alias(n) for n, v in facts(c)], *near(c))
    out = df.groupBy(by).agg(F.array(*[of(c) for c in columns]).alias("bands"))
    out = out.select(by, (F.get("bands", F.lit(0))["n"] * F.lit(float(pixel_area))).alias("area"), F.explode("bands").alias("b")).select(by, "area", "b.*")
    if not accuracy:
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).cast("double").alias("v")) for c in columns])).alias("b")
        q = exact_quantiles(df.select(F.struct(by).alias("_by"), values).select("_by", "b.*"), ["_by", "band"], "v", places)
        out = out.withColumn("_by", F.struct(by)).join(q.withColumnRenamed("quantiles", "q"), ["_by", "band"], "left")
    cut = [F.get(F.col("q"), F.lit(i)).alias(f"q{p}") for i, p in enumerate((25, 50, 75))]
    return out.select(by, "band", "n", "mean", "std", "min", *cut, "max", "area")


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("minx"), F.max(x).alias("maxx"), F.min(y).alias("miny"), F.max(y).alias("maxy"))


def snap_extent(ext: DataFrame, x0: float, sx: float, y0: float, sy: float) -> DataFrame:
    """An extent moved outward to the pixel grid: left and top to the grid line before, right and bottom a pixel on from
    theirs, also where they lie on a line."""
    c = F.col
    left, right = c("minx") - floor_mod(c("minx") - x0, sx), c("maxx") - floor_mod(c("maxx") - x0, sx) + sx
    top, bottom = c("maxy") - floor_mod(c("maxy") - y0, sy), c("miny") - floor_mod(c("miny") - y0, sy) + sy
    return ext.select(left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"))


def _extents(catalog: DataFrame) -> DataFrame:
    c = F.col
    names = ("minx", "maxx", "miny", "maxy")
    return catalog.withColumns(dict(zip(names, raster_extent(*map(c, ("x0", "sx", "y0", "sy", "width", "height", "rx", "ry"))), strict=True)))


def points_in_extents(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (point, image) whose extent (of a rotated image: the box around it) holds the point, edges included. Both sides go
    to the leaves of a quadtree over their density and meet there, so neither is copied whole; the exact test follows."""
    return points_in_boxes(points, _extents(catalog)).drop("minx", "maxx", "miny", "maxy")


def sample_at_points(points: DataFrame, catalog: DataFrame, pixels: DataFrame) -> DataFrame:
    """point_id, raster_id, pixel_value: a row for each image that has a pixel at the point. A point on the far edge is
    inside the extent but has no pixel."""
    c = F.col
    hit = points_in_extents(points, catalog)
    row, col = world_to_pixel(c("x"), c("y"), c("x0"), c("sx"), c("rx"), c("y0"), c("ry"), c("sy"))
    hit = hit.select("point_id", "raster_id", row.alias("row"), col.alias("col"))
    return hit.join(pixels, ["raster_id", "row", "col"]).select("point_id", "raster_id", c("value").alias("pixel_value"))


def attach_value(points: DataFrame, samples: DataFrame, field: str) -> DataFrame:
    """Points with the sampled value as a new or overwritten column; points outside keep null."""
    kept = points.drop(field)
    return kept.join(samples.select("point_id", F.col("pixel_value").alias(field)), "point_id", "left")


def sampling_report(points: DataFrame, catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """Numbers of points, images and hits in one row."""
    number = lambda df: df.agg(F.count("*")).scalar()
    return points.agg(F.count("*").alias("n_points")).select("n_points", number(catalog).alias("n_images"), number(samples).alias("n_hits"))


def align_origin(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """Catalog a with the origin of its partner in b: raster_ids of equal key (an expression on raster_id) are partners."""
    origin = b.select(key.alias("_key"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"))
    out = a.withColumn("_key", key).join(origin, "_key")
    return out.withColumn("x0", F.col("_x0")).withColumn("y0", F.col("_y0")).drop("_key", "_x0", "_y0")


def unflatten_grid(df: DataFrame, longitudes: int | None = None) -> DataFrame:
    """lon, lat, height of a flattened grid (pos, height, north, west, n_s, e_w): the last meridian repeats the first and
    goes; longitudes beyond 180 turn to the west. How many longitudes a row has follows from the header (which then has
    east too) unless it is given."""
    width = F.lit(longitudes) if longitudes else F.floor((F.col("east") - F.col("west")) / F.col("e_w")).cast("int") + 1
    i, j = F.floor(F.col("pos") / width), F.col("pos") % width
    lon = F.col("west") + j * F.col("e_w")
    wrapped = F.when(lon > 180, (lon + 180) % 360 - 180).otherwise(lon)
    keep = [c for c in ("grid",) if c in df.columns]
    return df.where(j < width - 1).select(*keep, wrapped.alias("lon"), (F.col("north") - i * F.col("n_s")).alias("lat"), "height")
