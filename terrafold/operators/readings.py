"""Hourly gauge readings: cleaning, complete days and months, rain days, station records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import days_in_month, decimal_comma, reading_time


def clean_readings(df: DataFrame, sentinels: tuple[str, ...] = ("-9999", "")) -> DataFrame:
    """code_wmo, v_datetime, prep_mm of raw text rows; sentinels and nulls are dropped. Junk text becomes null, not 0, so
    that a bad reading is never a dry one."""
    return df.where(~F.col("prep_mm").isin(*sentinels)).select("code_wmo", reading_time(F.col("data"), F.col("hora")).alias("v_datetime"), decimal_comma(F.col("prep_mm")).try_cast("double").alias("prep_mm"))


def restrict_stations(readings: DataFrame, subset: DataFrame) -> DataFrame:
    """Readings of the stations of subset, once for each time it has their code. The optimizer broadcasts a small subset
    by its size."""
    return readings.join(subset.select("code_wmo"), "code_wmo")


def between_dates(df: DataFrame, lo: str, hi: str, column: str = "v_date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def _by_day(readings: DataFrame) -> DataFrame:
    """One aggregation for all that is asked of a day: its rows and the sums of its two parts."""
    hour, rain = F.hour("v_datetime"), F.col("prep_mm")
    return readings.groupBy("code_wmo", F.col("v_datetime").cast("date").alias("v_date")).agg(
        F.count("*").alias("n"), F.sum(F.when(hour <= 12, rain)).alias("total_prep_mm_12"), F.sum(F.when(hour >= 13, rain)).alias("total_prep_mm_13")
    )


def half_day_totals(readings: DataFrame, expected: int = 24) -> DataFrame:
    """Sums of hours up to 12 and from 13 on of the complete days."""
    return _by_day(readings).where(F.col("n") == expected).drop("n")


def complete_days(readings: DataFrame, expected: int = 24) -> DataFrame:
    """Station days with exactly `expected` rows."""
    return half_day_totals(readings, expected).select("code_wmo", "v_date")


def keep_complete_days(readings: DataFrame, days: DataFrame) -> DataFrame:
    """Readings of the given station days."""
    dated = readings.withColumn("v_date", F.col("v_datetime").cast("date"))
    return dated.join(days, ["code_wmo", "v_date"], "left_semi")


def complete_months(days: DataFrame) -> DataFrame:
    """Station months in which every day is complete."""
    keys = F.date_format("v_date", "yyyy").alias("v_year"), F.date_format("v_date", "MM").alias("v_month")
    return days.groupBy("code_wmo", *keys).agg(F.count("*").alias("n_days"), F.min("v_date").alias("day")).where(F.col("n_days") == days_in_month(F.col("day"))).drop("day")


def rain_day_totals(readings: DataFrame, first: str | None = None, expected: int = 24) -> DataFrame:
    """Rain of hours 13-23 of the day before and 0-12 of the day, both complete; null if either part has no value.

    The day before is looked up in a window over one station's days, one shuffle after the aggregation.
    """
    by_station = Window.partitionBy("code_wmo").orderBy("v_date")
    halves = half_day_totals(readings, expected)
    halves = halves.withColumn("before", F.lag("v_date").over(by_station)).withColumn("late", F.lag("total_prep_mm_13").over(by_station))
    out = halves.where(F.col("before") == F.date_sub("v_date", 1))
    if first:
        out = out.where(F.col("v_date") >= F.date_add(F.lit(first).cast("date"), 1))
    return out.select("code_wmo", "v_date", (F.col("total_prep_mm_12") + F.col("late")).alias("prep_mm"))


def latest_station(stations: DataFrame, subset: DataFrame) -> DataFrame:
    """Records of the latest year of each station of subset; ties stay."""
    own = stations.join(subset.select("code_wmo").distinct(), "code_wmo", "left_semi")
    return own.withColumn("_rank", F.rank().over(Window.partitionBy("code_wmo").orderBy(F.desc("source_ano")))).where("_rank = 1").drop("_rank")


#: Rows are numbered in 16 ** ID_DIGITS ranges of a hash, each on its own.
ID_DIGITS = 3


def with_row_id(df: DataFrame, key: str, name: str = "fid") -> DataFrame:
    """df with ids from 1 on in the order of the hash of a key, then of the key; rows that repeat a key (or have none) follow
    each other in any order. Ranges of the hash are counted first, so no task numbers all rows."""
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.withColumn("_hash", hashed).withColumn("_range", F.substring(hashed, 1, ID_DIGITS))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", key))
    return rows.withColumn("_place", place).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_hash", "_range", "_n", "_start", "_place")


def station_points(stations: DataFrame, key: str | None = None) -> DataFrame:
    """Stations with a numeric point from their text coordinates, null where these are no numbers, and, given the column
    that tells stations apart, with a row id (fid)."""
    out = stations.withColumn("point", F.struct(F.col("long").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat")))
    return with_row_id(out, key) if key else out
