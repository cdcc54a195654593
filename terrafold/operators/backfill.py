"""Loads by day that can be broken off and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists

#: Days loaded between two entries in the manifest.
AT_ONCE = 31


def loaded_days(spark: SparkSession, path: str) -> DataFrame:
    """v_date, n of the days that are loaded, with their numbers of rows; a day may have none."""
    schema = "v_date date, n long"
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifest").distinct()


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all loaded days, in one scan with v_date as a partition column. Rows of a day that isn't in the manifest
    belong to a load that was broken off; they are passed over. The manifest has a row a day."""
    if not exists(spark, f"{path}/days"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/days")
    return rows.join(F.broadcast(loaded_days(spark, path).select("v_date")), "v_date", "left_semi").select(*rows.columns)


def load_days(spark: SparkSession, path: str, days: DataFrame, rows_of: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE) -> int:
    """Load the days (v_date) that are not loaded yet; how many there were.

    rows_of gives the rows, v_date among them, of a table of days. Days are loaded in their order, at_once at a time: their
    partitions replace what an earlier load may have left of them, then they enter the manifest. So a load that is broken
    off anywhere, run again or run twice ends with the same rows, and costs the missing days alone.
    """
    missing = days.select("v_date").where("v_date IS NOT NULL").distinct().join(loaded_days(spark, path), "v_date", "left_anti")
    # One number a day.
    left = sorted(r["v_date"] for r in missing.collect())
    for at in range(0, len(left), at_once):
        part = spark.createDataFrame([(d,) for d in left[at : at + at_once]], "v_date date")
        rows = rows_of(part).join(F.broadcast(part), "v_date", "left_semi")
        rows.repartition("v_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("v_date").parquet(f"{path}/days")
        there = spark.read.schema(rows.schema).parquet(f"{path}/days").join(F.broadcast(part), "v_date", "left_semi").groupBy("v_date").agg(F.count("*").alias("n"))
        part.join(there, "v_date", "left").select("v_date", F.coalesce("n", F.lit(0)).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(left)
