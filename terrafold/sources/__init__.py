"""Readers and writers. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decimal_comma
from .lines import file_lines

#: Header lines of a station file, in their order; and the fields of its rows. Fixed values.
FACTS = ("regiao", "uf", "estacao", "code_wmo", "lat", "long", "alt", "data")
MEASURES = (
    "prep_mm", "pres_mb", "pres_max_mb", "pres_min_mb", "rad_wm2", "temp_bulbo_c", "temp_pont_orv_c", "temp_max_c", "temp_min_c", "temp_orv_max_c", "temp_orv_min_c",
    "umid_max_p", "umid_min_p", "umid_p", "vent_dir_g", "vent_max_ms", "vent_vel_ms",
)


def reading_fields(line) -> list:
    """The fields of a row of a station file, decimal commas as points; short rows end in nulls, long ones are cut."""
    parts = F.split(line, ";")
    return [decimal_comma(F.get(parts, F.lit(i))).alias(name) for i, name in enumerate(("data", "hora", *MEASURES))]


#: Lines of facts and the line of names before the rows of a station file.
HEAD = len(FACTS) + 1


def read_station_files(spark: SparkSession, path: str, glob: str = "*.CSV", source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations and readings of a directory of station files: eight lines of facts, a header line, then hourly rows.

    Files are read in parts, so one of any size is spread; the facts stand in a file's first part and meet its rows by the
    path, a row a file. source: an expression on the file's `path` that names it; its stem by default.
    """
    lines = file_lines(spark, path, glob=glob).withColumn("line", F.decode("line", "ISO-8859-1"))
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1) if source is None else source
    head = (F.col("start") == 0) & (F.col("number") < HEAD)
    fact = {name: F.max(F.when(F.col("number") == i, decimal_comma(F.get(F.split("line", ";"), F.lit(1))))).alias(name) for i, name in enumerate(FACTS)}
    files = lines.where(head).groupBy("path").agg(*fact.values()).withColumn("source", stem)
    kinds = {"lat": "double", "long": "double", "alt": "double"}
    year = F.regexp_extract("source", r"([^_-]*)$", 1).try_cast("int")
    stations = files.select("source", year.alias("source_ano"), *[(F.col(n).try_cast(kinds[n]) if n in kinds else F.col(n)).alias(n) for n in FACTS])
    rows = lines.where(~head & (F.trim("line") != "")).join(files.select("path", "source", "code_wmo"), "path")
    return stations, rows.select("source", "code_wmo", *reading_fields(F.col("line")))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of an `id;lat;long` file with a header."""
    return spark.read.schema("id string, lat double, long double").option("sep", ";").option("header", True).csv(path)


#: Names of the stacked bands. Fixed values.
BANDS = ("AW3D30", "NASADEM")


def read_band_csvs(spark: SparkSession, path: str, bands: tuple[str, ...] = BANDS, name: Column | None = None) -> DataFrame:
    """Stacked bands of the CSV files of a directory, first lines skipped. name: an expression on `_metadata` that names a
    file's rows; the file's stem, up to the first point, by default."""
    rows = spark.read.schema(", ".join(f"{b} int" for b in bands)).option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1) if name is None else name)


def read_text_grid(spark: SparkSession, path: str, longitudes: int | None = None, grid: Column | None = None) -> DataFrame:
    """grid, lon, lat, height of text grids: six header numbers, then values in blocks; lines under four characters are empty.
    Files are read in parts, of any size; a value's place follows from the numbers of the parts before. How many longitudes there are follows from each header, unless it is given. grid: an expression on `_metadata` that
    names a file; its path by default."""
    from ..operators.pixels import unflatten_grid

    # A line's numbers; lines under four characters are empty, and the first other one is the header.
    weigh = lambda line: len(line.split()) if len(line.strip()) >= 4 else 0
    lines = file_lines(spark, path, name=grid, weigh=weigh).withColumn("line", F.col("line").cast("string"))
    lines = lines.withColumn("numbers", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).where(F.length(F.trim("line")) >= 4)
    first = (F.col("start") == 0) & (F.col("before") == 0)
    names = ("south", "north", "west", "east", "n_s", "e_w")
    heads = lines.where(first).select("path", *[F.element_at("numbers", i + 1).cast("double").alias(n) for i, n in enumerate(names)], F.size("numbers").alias("head"))
    # Where the numbers of a part begin in its file: a row a part.
    parts = lines.groupBy("path", "start").agg(F.max(F.col("before") + F.size("numbers")).alias("n"))
    begin = parts.withColumn("begin", F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")).drop("n")
    values = lines.where(~first).join(begin, ["path", "start"]).join(heads, "path")
    each = values.select(F.col("name").alias("grid"), *names, (F.col("begin") + F.col("before") - F.col("head")).alias("at"), F.posexplode("numbers").alias("i", "number"))
    return unflatten_grid(each.select("grid", *names, (F.col("at") + F.col("i")).cast("int").alias("pos"), F.col("number").cast("double").alias("height")), longitudes)


def pixels_from_parquet(spark: SparkSession, path: str, nodata: float | None) -> DataFrame:
    """A pixel table with nodata and NaN as nulls."""
    from ..operators.pixels import nodata_to_null

    return nodata_to_null(spark.read.parquet(path), "value", nodata)


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "errorifexists") -> None:
    """Delimited text with a header; what is at path already is an error unless mode says otherwise."""
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def save(df: DataFrame, name: str, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Register df as a view, materialised as Parquet first if a path is given."""
    if path:
        df.write.mode(mode).parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df
