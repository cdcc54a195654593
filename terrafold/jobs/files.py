"""Queries that write files composed from the tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..storage import new_path
from .common import lines, part_raster, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def folder(name: str, column: str = "path"):
    """The value of a folder `name=value` in a file's path."""
    return F.regexp_extract(column, name + "=([^/]*)/", 1)


def station_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stations and readings of the files of all stations and days: eight lines of facts, a header line and the day's rows."""
    at = F.concat_ws("_", "code_wmo", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "yyyy"))
    rows = lines(spark, sf_dir, "ts").withColumn("source", at)
    body = rows.groupBy("source", "code_wmo").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    facts = F.concat(F.lit("REGIAO:;CO\nUF:;DF\nESTACAO:;"), F.upper("code_wmo"), F.lit("\nCODIGO:;"), F.col("code_wmo"), F.lit("\nLATITUDE:;-15,79\nLONGITUDE:;-47,93\nALTITUDE:;"), F.col("n").cast("string"), F.lit(",5\nDATA:;07/05/00\nData;Hora;Prep\n"))
    path = new_path(spark, "stations")
    body.select("source", F.concat(facts, "body").alias("value")).repartition("source").write.partitionBy("source").text(path)
    return sources.read_station_files(spark, path, "*.txt", folder("source"))


@query("""
SELECT event_type || '_' || strftime(ts, '%Y%m%d_%Y') AS source, CAST(year(ts) AS INTEGER) AS source_ano, 'CO' AS regiao, 'DF' AS uf, upper(event_type) AS estacao, event_type AS code_wmo,
       -15.79::DOUBLE AS lat, -47.93::DOUBLE AS long, count(*) + 0.5::DOUBLE AS alt, '07/05/00' AS data
FROM events GROUP BY ALL""")
def station_facts(spark, sf_dir):
    return station_files(spark, sf_dir)[0]


@query("""
SELECT event_type || '_' || strftime(ts, '%Y%m%d_%Y') AS source, event_type AS code_wmo, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d') END AS data,
       CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H%M') || ' UTC' ELSE strftime(ts, '%H:%M') END AS hora,
       CASE WHEN event_id % 17 = 0 THEN '-9999' WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'x' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS prep_mm,
       CAST(user_id AS VARCHAR) AS pres_mb, CAST(NULL AS VARCHAR) AS vent_vel_ms
FROM events""")
def station_readings(spark, sf_dir):
    return station_files(spark, sf_dir)[1].select("source", "code_wmo", "data", "hora", "prep_mm", "pres_mb", "vent_vel_ms")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS lat, CAST(c_custkey % 90 AS DOUBLE) AS long FROM customer")
def points_file(spark, sf_dir):
    """All customers as points, in delimited text and back."""
    path = new_path(spark, "points")
    k = F.col("c_custkey")
    sources.write_delimited(table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.col("c_acctbal").cast("decimal(18,2)").alias("lat"), (k % 90).cast("double").alias("long")), path)
    return sources.read_points(spark, path)


@query("SELECT p_brand AS name, CAST(p_size AS INTEGER) AS AW3D30, CAST(p_partkey AS INTEGER) AS NASADEM FROM part")
def band_csvs(spark, sf_dir):
    """Two bands of all parts in CSV files, a folder for each brand, and back."""
    path = new_path(spark, "bands")
    table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "Brand#", "").alias("name"), "p_size", "p_partkey").write.partitionBy("name").option("header", True).csv(path)
    out = sources.read_band_csvs(spark, path, name=F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/", 1))
    return out.withColumn("name", F.concat(F.lit("Brand#"), "name"))


@query("""WITH v AS (SELECT vec_id // 4 AS grid, embedding, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 AS k FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT grid, k, unnest(embedding) AS height, generate_subscripts(embedding, 1) - 1 AS pos FROM v),
p AS (SELECT grid, height, k * 4 + pos // 16 AS i, pos % 16 AS j FROM g)
SELECT CAST(grid AS VARCHAR) AS grid, CAST(CASE WHEN j * 24 > 180 THEN (j * 24 + 180) % 360 - 180 ELSE j * 24 END AS DOUBLE) AS lon, CAST(90 - i * 12 AS DOUBLE) AS lat, CAST(height AS DOUBLE) AS height FROM p WHERE j < 15""")
def text_grid_files(spark, sf_dir):
    """A text grid of every four vectors, a line for each of them, the number of longitudes left to the header."""
    four = table(spark, sf_dir, "embeddings").where("embedding is not null").groupBy(F.floor(F.col("vec_id") / 4).alias("grid")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r["embedding"], lambda x: x.cast("double").cast("string")), " ")), "\n\n")
    path = new_path(spark, "grids")
    four.select("grid", F.concat(F.lit("-90 90 0 360 12 24\n"), text).alias("value")).repartition("grid").write.partitionBy("grid").text(path)
    return sources.read_text_grid(spark, path, grid=F.regexp_extract(F.col("_metadata.file_path"), "grid=([^/]*)/", 1))


@query("SELECT p_brand, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM part GROUP BY 1")
def saved_view(spark, sf_dir):
    """A table saved as Parquet and as a view, asked in SQL."""
    sources.save(table(spark, sf_dir, "part"), "saved_parts", new_path(spark, "parts"))
    return spark.sql("select p_brand, count(*) as n, cast(sum(cast(p_retailprice as decimal(18,2))) as double) as price from saved_parts group by p_brand")


@query('SELECT CAST(p_partkey // 40 AS INTEGER) AS "row", CAST(p_partkey % 40 AS INTEGER) AS col, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS value FROM part')
def pixels_file(spark, sf_dir):
    """The class raster as a pixel table in Parquet and back, nodata as nulls."""
    path = new_path(spark, "pixels")
    part_raster(spark, sf_dir).select("row", "col", F.col("class_id").cast("double").alias("value")).write.parquet(path)
    return sources.pixels_from_parquet(spark, path, 7.0)
