"""The batch operators that also run on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def satellite_daily_stream(samples: DataFrame, late: str = "1 day", factor: float = 10.0) -> DataFrame:
    """id, v_date, total_mm of a stream of half-hourly samples (id, ts, value): days from 12:00 to 12:00, named by their
    end, closed when the watermark passes them."""
    w = F.window("ts", "1 day", "1 day", "12 hours")
    sums = samples.withWatermark("ts", late).groupBy("id", w.alias("w")).agg((F.sum("value") / factor).alias("total_mm"))
    return sums.select("id", F.col("w.end").cast("date").alias("v_date"), "total_mm")
