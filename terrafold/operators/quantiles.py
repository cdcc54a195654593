"""Exact quantiles of groups by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path, removed

#: Steps into which the values between two powers of two are counted at first; about 270,000 counters cover all doubles.
STEPS = 64
#: Parts into which a bucket is cut when it is refined.
PARTS = 4096
#: A bucket of so many rows isn't refined any more; its distinct values are ordered.
SMALL = 1 << 16


def order_key(v: Column) -> Column:
    """A whole number that never falls as v rises: sign, power of two and STEPS steps on from it; NaN comes last."""
    size = F.floor(F.log2(F.abs(v)) * STEPS) + 1100 * STEPS
    return F.when(F.isnan(v), 1 << 20).when(v == float("inf"), 1 << 19).when(v == float("-inf"), -(1 << 19)).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def _written(df: DataFrame, made: list[str]) -> DataFrame:
    path = new_path(df.sparkSession, "quantiles")
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, places: tuple[float, ...], small: int = SMALL) -> DataFrame:
    """keys and `quantiles`, an array of the values at the places (0 to 1) of each group, interpolated between neighbours;
    null values are left out, a group without any is in no row.

    Rows are counted by an order-preserving key. The buckets that hold a wanted rank are kept, their rows are cut into PARTS
    by value, and so on, until a bucket holds one value or few rows. A group costs one histogram, whatever it holds: its
    rows are never brought together. The number of rounds follows from the widths of doubles, not from the rows: five at most.
    """
    made: list[str] = []
    # One struct for all keys, so that null keys meet in joins.
    rows = df.select(F.struct(*keys).alias("key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    group = Window.partitionBy("key")
    counted = rows.groupBy("key", order_key(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    counted = counted.withColumns({"start": F.sum("n").over(group.orderBy("bucket")) - F.col("n"), "total": F.sum("n").over(group)})
    at = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    wanted = F.array(*[r for p in places for r in (F.floor(at(p)), F.ceil(at(p)))])
    within = lambda ranks, start: F.filter(ranks, lambda r: (r >= F.col(start)) & (r < F.col(start) + F.col("n")))
    kept = _written(counted.withColumn("ranks", F.array_distinct(within(wanted, "start"))).where(F.size("ranks") > 0), made)
    values = kept.where("NOT (lo < hi)").select("key", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    totals = kept.select("key", "total").distinct()
    left = kept.where("lo < hi")
    largest = left.agg(F.max("n")).first()[0]
    rows = rows.withColumn("bucket", order_key(F.col("v"))).join(left.select("key", "bucket", "start", "lo", "hi", "ranks"), ["key", "bucket"]).drop("bucket")
    # A bucket is known by its key and the rank at which it starts.
    place = ["key", "start"]
    while largest:
        last = largest <= small
        rows = rows if last else _written(rows, made)
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS)).cast("double")
        rows = rows.withColumn("part", F.col("v") if last else part)
        counted = rows.groupBy(*place, "part", "ranks").agg(F.count("*").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        counted = counted.withColumn("new_start", F.col("start") + F.sum("n").over(Window.partitionBy(*place).orderBy("part")) - F.col("n"))
        kept = _written(counted.withColumn("new_ranks", within("ranks", "new_start")).where(F.size("new_ranks") > 0), made)
        values = values.unionByName(kept.where("NOT (new_lo < new_hi)").select("key", F.explode("new_ranks").alias("rank"), F.col("new_lo").alias("v")))
        if last:
            break
        left = kept.where("new_lo < new_hi")
        largest = left.agg(F.max("n")).first()[0]
        renamed = {f"new_{c}": c for c in ("start", "lo", "hi", "ranks")}
        rows = rows.drop("lo", "hi", "ranks").join(left.drop("n", "ranks"), [*place, "part"]).drop("start", "part").withColumnsRenamed(renamed)
    by_rank = values.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("m")).join(totals, "key")
    value_at = lambda r: F.element_at("m", r.cast("long"))
    between = lambda p: value_at(F.floor(at(p))) + (value_at(F.ceil(at(p))) - value_at(F.floor(at(p)))) * (at(p) - F.floor(at(p)))
    each = [F.when(F.floor(at(p)) == at(p), value_at(F.floor(at(p)))).otherwise(between(p)) for p in places]
    # The result has a row a group; with it written, nothing else is read any more.
    out = _written(by_rank.select("key.*", F.array(*each).alias("quantiles")), made)
    for path in made[:-1]:
        removed(df.sparkSession, path)
    return out
