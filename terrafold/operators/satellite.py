"""Half-hourly satellite granules: calendar, daily totals, gaps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import granule_name, inside, raster_extent, world_to_pixel

#: A grid is cut into so many tiles at most; their numbers can be listed in a filter.
MOST_TILES = 4096


def granule_calendar(dates: DataFrame) -> DataFrame:
    """The 48 granules of each v_date: from 12:00 of the day before, each half an hour less a second."""
    noon = F.col("v_date").cast("timestamp_ntz")
    starts = F.explode(F.sequence(noon - F.expr("interval 12 hours"), noon + F.expr("interval 690 minutes"), F.expr("interval 30 minutes")))
    out = dates.select("v_date", starts.alias("start"))
    return out.select("v_date", "start", (F.col("start") + F.expr("interval 1799 seconds")).alias("end"), granule_name(F.col("start")).alias("granule"))


def satellite_daily(samples: DataFrame, stations: DataFrame, dates: DataFrame, factor: float = 10.0) -> DataFrame:
    """id, v_date, total_mm: each station's half-hourly samples (id, ts, value) from 12:00 of the day before to 11:59, by
    factor. A station without a sample has 0; missing granules are passed over.

    stations and dates are the grid that is asked for: its rows are those of the result. Dates become one array.
    """
    day = (F.col("ts") + F.expr("interval 12 hours")).cast("date")
    sums = samples.groupBy("id", day.alias("v_date")).agg((F.sum("value") / factor).alias("total_mm"))
    grid = stations.select("id", F.explode(dates.agg(F.collect_list("v_date")).scalar()).alias("v_date"))
    return grid.join(sums, ["id", "v_date"], "left").select("id", "v_date", F.coalesce("total_mm", F.lit(0)).alias("total_mm"))


def missing_granules(expected: DataFrame, present: DataFrame) -> DataFrame:
    """v_date and message of each expected granule that is not there."""
    gone = expected.join(present.select("granule"), "granule", "left_anti")
    return gone.select("v_date", F.concat(F.lit("missing granule "), "granule").alias("message"))


def tile_side(grid: dict[str, float]) -> int:
    """Pixels along the side of a tile, so that a grid (x0, sx, y0, sy, width, height) has MOST_TILES of them at most."""
    side = 8
    while -(-int(grid["width"]) // side) * -(-int(grid["height"]) // side) > MOST_TILES:
        side *= 2
    return side


def tile_of(row: Column, col: Column, grid: dict[str, float]) -> Column:
    side = tile_side(grid)
    across = -(-int(grid["width"]) // side)
    return (F.floor(row / side) * across + F.floor(col / side)).cast("int")


def write_granules(px: DataFrame, path: str, grid: dict[str, float], mode: str = "errorifexists") -> None:
    """Granule pixels (start, row, col, value) as Parquet, a folder for each v_date that a granule counts for and, in it, for
    each tile; rows of a tile are sorted by row and col, so that a reader skips what it doesn't ask for. A day's pixels are
    dealt by tiles."""
    day = (F.col("start") + F.expr("interval 12 hours")).cast("date")
    rows = px.select(day.alias("v_date"), tile_of(F.col("row"), F.col("col"), grid).alias("tile"), "start", "row", "col", "value")
    rows.repartition("v_date", "tile").sortWithinPartitions("v_date", "tile", "row", "col", "start").write.mode(mode).partitionBy("v_date", "tile").parquet(path)


def station_cells(stations: DataFrame, grid: dict[str, float]) -> DataFrame:
    """id, row, col, tile of the stations (id, lon, lat) that have a pixel of the grid under them; edges count as outside where
    no pixel begins."""
    ext = raster_extent(*(F.lit(grid[k]) for k in ("x0", "sx", "y0", "sy", "width", "height")))
    row, col = world_to_pixel(F.col("lon"), F.col("lat"), *(F.lit(float(grid.get(k, 0))) for k in ("x0", "sx", "rx", "y0", "ry", "sy")))
    at = stations.where(inside(F.col("lon"), F.col("lat"), *ext)).select("id", row.alias("row"), col.alias("col"))
    return at.where((F.col("row") < int(grid["height"])) & (F.col("col") < int(grid["width"]))).withColumn("tile", tile_of(F.col("row"), F.col("col"), grid))


def sample_granules(granules: DataFrame, stations: DataFrame, grid: dict[str, float], first: str | None = None, last: str | None = None) -> DataFrame:
    """id, ts, value: the pixel under each station in each granule of the days from first to last (all, if not given).

    granules: what write_granules wrote, read. The cells of the stations are known first: their tiles, MOST_TILES at most,
    and the span of their rows and columns become filters of the scan, so folders and row groups without a station are not
    read. What is left meets the cells by tile, row and col; stations in one cell share its pixels. Null values are passed over.
    """
    cells = station_cells(stations, grid)
    facts = cells.agg(F.collect_set("tile").alias("tiles"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))]).first()
    tests = [F.col("tile").isin(sorted(facts["tiles"]))]
    tests += [F.col(c).between(facts[f"min_{c}"], facts[f"max_{c}"]) for c in ("row", "col")]
    tests += [F.col("v_date") >= F.lit(first).cast("date")] if first else []
    tests += [F.col("v_date") <= F.lit(last).cast("date")] if last else []
    scan = granules.where(reduce(and_, tests)).where("value IS NOT NULL").select("tile", "row", "col", F.col("start").alias("ts"), "value")
    return scan.join(cells, ["tile", "row", "col"]).select("id", "ts", "value")


def station_rain(granules: DataFrame, stations: DataFrame, dates: DataFrame, grid: dict[str, float], factor: float = 10.0) -> DataFrame:
    """id, v_date, total_mm of every station on each of the dates: its granules' pixels from 12:00 of the day before, summed and
    divided by factor; 0 where it has none. Only the granules of the dates' span are read."""
    span = dates.agg(F.min("v_date").alias("first"), F.max("v_date").alias("last")).first()
    text = [None if d is None else d.isoformat() for d in span]
    return satellite_daily(sample_granules(granules, stations, grid, *text), stations, dates, factor)
