"""Inputs of the queries, shaped from the driver's tables, and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed, state

#: The years at the edge of the data, left out of the scores.
EDGE_YEARS = (1995, 2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(name: str) -> Column:
    """A date as text, so that all engines write it alike."""
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def number(name: str, digits: int = 4) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_wmo, v_date, inmet_prep, gpm_prep: observed and estimated rain by station and day, in one aggregation; sums of
    decimals, so that thresholds don't depend on their order."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", F.col("l_shipdate").cast("date").alias("v_date"))
    code = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = line.join(code.select("s_suppkey", F.col("n_regionkey").cast("string").alias("code_wmo")), F.col("l_suppkey") == F.col("s_suppkey"))
    money = lambda c: F.col(c).cast("decimal(18,2)")
    observed = F.when(F.col("l_returnflag") == "R", money("l_quantity")).otherwise(0)
    estimated = F.when(F.col("l_linestatus") == "O", 2 * money("l_tax")).otherwise(0)
    return rows.groupBy("code_wmo", "v_date").agg(F.sum(observed).alias("inmet_prep"), F.sum(estimated).alias("gpm_prep"))


def daily_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_sums as a table in buckets by station and day, made once for a session and state of the inputs; all queries on
    daily rain share it."""
    name = "daily_rain_" + state(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation")))
    return bucketed(daily_sums(spark, sf_dir), name, ["code_wmo", "v_date"])


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observed and estimated rain as tables of their own, in the same buckets."""
    both = daily_store(spark, sf_dir)
    return tuple(both.select("code_wmo", "v_date", F.col(c).alias("prep_mm")) for c in ("inmet_prep", "gpm_prep"))


PAIRS = """
pairs AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS code_wmo, CAST(l_shipdate AS DATE) AS v_date,
         sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS inmet_prep,
         sum(CASE WHEN l_linestatus = 'O' THEN 2 * CAST(l_tax AS DECIMAL(18,2)) ELSE 0 END) AS gpm_prep
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings: events summed by type and hour."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code_wmo"), hour.alias("v_datetime")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("prep_mm"))


READINGS = """
readings AS (
  SELECT event_type AS code_wmo, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS v_datetime, sum(CAST(value AS DECIMAL(18,2))) AS prep_mm
  FROM events GROUP BY 1, 2)"""

HALVES = """
halves AS (
  SELECT code_wmo, CAST(v_datetime AS DATE) AS v_date, sum(CASE WHEN hour(v_datetime) <= 12 THEN prep_mm END) AS total_prep_mm_12,
         sum(CASE WHEN hour(v_datetime) >= 13 THEN prep_mm END) AS total_prep_mm_13
  FROM readings GROUP BY 1, 2 HAVING count(*) = 24)"""


def lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Rows of station files as text, composed from events: decimal commas, two ways to write a time, sentinels, junk."""
    value = F.when(F.col("event_id") % 17 == 0, "-9999").when(F.col("event_id") % 19 == 0, "").when(F.col("event_id") % 23 == 0, "x").otherwise(F.translate(F.col("value").cast("decimal(18,2)").cast("string"), ".", ","))
    even = F.col("event_id") % 2 == 0
    day = F.when(even, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    time = F.when(even, F.concat(F.date_format("ts", "HHmm"), F.lit(" UTC"))).otherwise(F.date_format("ts", "HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code_wmo"), F.concat_ws(";", day, time, value, F.col("user_id").cast("string")).alias("line"), *more)


def part_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 40 columns: a pixel for each part, with its price and a class."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("part").alias("raster_id"), F.floor(key / 40).cast("int").alias("row"), (key % 40).cast("int").alias("col"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("class_id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on half pixels and on the edges between images, from the top of the part raster down; some lie beside it."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (k % 90 / 2).alias("x"), (-F.floor(k / 15) / 2).alias("y"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of 10 by 10 pixels that tile the part raster."""
    at = part_raster(spark, sf_dir).select(F.floor(F.col("row") / 10).alias("r"), F.floor(F.col("col") / 10).alias("c")).distinct()
    return at.select(
        F.concat_ws("_", "r", "c").alias("raster_id"), (F.col("c") * 10.0).alias("x0"), F.lit(1.0).alias("sx"), F.lit(0.0).alias("rx"), (F.col("r") * -10.0).alias("y0"), F.lit(0.0).alias("ry"),
        F.lit(-1.0).alias("sy"), F.lit(10).alias("width"), F.lit(10).alias("height"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of all images of the catalog: each pixel of the part raster is in one."""
    row, col = F.col("row"), F.col("col")
    image = F.concat_ws("_", F.floor(row / 10), F.floor(col / 10))
    return part_raster(spark, sf_dir).select(image.alias("raster_id"), (row % 10).alias("row"), (col % 10).alias("col"), "value")


PART = "px AS (SELECT CAST(p_partkey // 40 AS INTEGER) AS row_, CAST(p_partkey % 40 AS INTEGER) AS col_, p_retailprice AS value, p_size AS class_id, p_partkey FROM part)"
CATALOG = PART + ", catalog AS (SELECT DISTINCT (row_ // 10) || '_' || (col_ // 10) AS raster_id, col_ // 10 * 10.0 AS x0, row_ // 10 * -10.0 AS y0 FROM px)"
POINTS = "points AS (SELECT c_custkey AS point_id, (c_custkey % 90) / 2.0::DOUBLE AS x, -(c_custkey // 15) / 2.0::DOUBLE AS y FROM customer)"
HITS = "hits AS (SELECT point_id, x, y, raster_id, x0, y0 FROM points JOIN catalog ON x BETWEEN x0 AND x0 + 10 AND y BETWEEN y0 - 10 AND y0)"
