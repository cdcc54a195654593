"""Sampling of granules at stations, and loads by day that are broken off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrafold.operators import satellite as S
from terrafold.operators.backfill import load_days, loaded_days, read_days
from terrafold.storage import new_path

GRID = {"x0": 10.0, "sx": 0.5, "y0": 50.0, "sy": -0.5, "width": 40, "height": 24}
SCHEMA = "start timestamp_ntz, row int, col int, value double, v_date date, tile int"


@pytest.fixture(scope="module")
def granules(spark):
    """Four days of half hours from noon to noon, value 1 everywhere but for nulls on one pixel."""
    starts = spark.sql("select explode(sequence(timestamp_ntz'2020-01-01 12:00:00', timestamp_ntz'2020-01-05 11:30:00', interval 30 minutes)) as start")
    rows = starts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(3))))
    px = rows.withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 3), None).otherwise(F.col("row") * 100.0 + F.col("col")))
    path = new_path(spark, "granules")
    S.write_granules(px, path, GRID)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def stations(spark):
    rows = [("a", 10.1, 49.9), ("same", 10.4, 49.6), ("b", 13.2, 38.4), ("nulls", 11.6, 49.3), ("no pixel", 10.6, 49.9), ("out", 9.9, 49.9), ("right edge", 30.0, 49.9), ("bottom edge", 10.1, 38.0), ("nowhere", None, 1.0)]
    return spark.createDataFrame(rows, "id string, lon double, lat double")


def test_cells_of_stations(stations):
    got = {r["id"]: (r["row"], r["col"]) for r in S.station_cells(stations, GRID).collect()}
    assert got == {"a": (0, 0), "same": (0, 0), "b": (23, 6), "nulls": (1, 3), "no pixel": (0, 1)}


def test_daily_totals(spark, granules, stations):
    dates = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (2, 4, 6)], "v_date date")
    got = {(r["id"], r["v_date"].day): r["total_mm"] for r in S.station_rain(granules, stations, dates, GRID).collect()}
    assert len(got) == 9 * 3
    assert got["b", 2] == got["b", 4] == 48 * 2306.0 / 10 and got["b", 6] == 0
    assert got["a", 2] == got["same", 2] == 0 and all(got[k, d] == 0 for k in ("nulls", "no pixel", "out", "right edge", "nowhere") for d in (2, 4, 6))


def test_the_scan_is_told_tiles_days_and_cells(spark, granules, stations):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    df = S.sample_granules(granules, stations, GRID, "2020-01-03", "2020-01-04")
    plan = df._jdf.queryExecution().toString()
    scan = next(line for line in plan[plan.index("== Physical Plan ==") :].splitlines() if "FileScan" in line)
    assert "tile#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "v_date#" in scan.split("PartitionFilters: [")[1]
    assert "GreaterThanOrEqual(row,0)" in scan and "LessThanOrEqual(col,6)" in scan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    tiles = {r["tile"] for r in S.station_cells(stations, GRID).select("tile").distinct().collect()}
    assert len(tiles) < granules.select("tile").distinct().count()


def test_no_station_and_no_date(spark, granules, stations):
    dates = spark.createDataFrame([(dt.date(2020, 1, 2),)], "v_date date")
    assert S.station_rain(granules, stations.limit(0), dates, GRID).count() == 0
    assert S.station_rain(granules, stations, dates.limit(0), GRID).count() == 0


def test_tiles_of_a_large_grid_are_few():
    large = {"width": 3600 * 100, "height": 1800 * 100}
    side = S.tile_side(large)
    assert -(-large["width"] // side) * -(-large["height"] // side) <= S.MOST_TILES and S.tile_side(GRID) == 8


def days_of(spark, *numbers):
    return spark.createDataFrame([(dt.date(2021, 5, n),) for n in numbers], "v_date date")


ROWS = "station string, mm int, v_date date"


def test_loads_are_taken_up_again(spark):
    path, asked = new_path(spark, "days"), []

    def rows_of(part):
        asked.append(sorted(r["v_date"].day for r in part.collect()))
        # Day 4 has no rows; days beside those asked for come too.
        return spark.createDataFrame([("s", n, dt.date(2021, 5, n)) for n in range(1, 9) if n != 4], ROWS)

    def broken(part):
        rows_of(part)
        if len(asked) == 3:
            raise RuntimeError("broken off")
        return rows_of(part)

    rows = lambda: sorted((r["v_date"].day, r["mm"]) for r in read_days(spark, path, ROWS).collect())
    assert rows() == []
    with pytest.raises(RuntimeError):
        load_days(spark, path, days_of(spark, 1, 2, 3, 4, 5), broken, at_once=2)
    assert rows() == [(1, 1), (2, 2)]
    asked.clear()
    assert load_days(spark, path, days_of(spark, 5, 4, 3, 2, 1, 1), rows_of, at_once=2) == 3
    assert asked == [[3, 4], [5]] and rows() == [(n, n) for n in (1, 2, 3, 5)]
    assert load_days(spark, path, days_of(spark, 1, 2, 3, 4, 5), rows_of) == 0 and len(asked) == 2
    assert {r["v_date"].day: r["n"] for r in loaded_days(spark, path).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def test_what_a_broken_load_left_is_replaced(spark):
    """Rows written but not in the manifest are passed over, and replaced by the next load."""
    path = new_path(spark, "days")
    load_days(spark, path, days_of(spark, 1), lambda p: p.selectExpr("'s' as station", "1 as mm", "v_date"))
    days_of(spark, 2).selectExpr("'half' as station", "99 as mm", "v_date").write.mode("append").partitionBy("v_date").parquet(f"{path}/days")
    assert [r["mm"] for r in read_days(spark, path, ROWS).collect()] == [1]
    load_days(spark, path, days_of(spark, 1, 2), lambda p: p.selectExpr("'s' as station", "2 as mm", "v_date"))
    assert sorted((r["station"], r["mm"]) for r in read_days(spark, path, ROWS).collect()) == [("s", 1), ("s", 2)]
