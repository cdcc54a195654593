"""Observed and estimated rain side by side, by day, month and season."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import days_in_month, rain_class, season


def pair(obs: DataFrame, est: DataFrame) -> DataFrame:
    """code_wmo, v_date, inmet_prep, gpm_prep of the station days that both have."""
    left = obs.select("code_wmo", "v_date", F.col("prep_mm").alias("inmet_prep"))
    return left.join(est.select("code_wmo", "v_date", F.col("prep_mm").alias("gpm_prep")), ["code_wmo", "v_date"])


def append_chunks(chunks: list[DataFrame]) -> DataFrame:
    """All rows of all chunks, by name."""
    return reduce(DataFrame.unionByName, chunks)


def exclude_years(df: DataFrame, years: tuple[int, ...], column: str = "v_date") -> DataFrame:
    return df.where(~F.year(column).isin(*years))


def scatter_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("gpm_prep").alias("Estimados"), F.col("inmet_prep").alias("Observados"))


def station_days(df: DataFrame) -> DataFrame:
    """Pairs with year, month and day as text; sort at the sink."""
    parts = [F.date_format("v_date", f).alias(n) for n, f in (("v_year", "yyyy"), ("v_month", "MM"), ("v_day", "dd"))]
    return df.select("code_wmo", *parts, "inmet_prep", "gpm_prep")


def monthly_totals(pairs: DataFrame) -> DataFrame:
    """Totals of the station months in which every day is paired."""
    keys = F.date_format("v_date", "yyyy").alias("v_year"), F.date_format("v_date", "MM").alias("v_month")
    by = pairs.groupBy("code_wmo", *keys).agg(F.sum("inmet_prep").alias("inmet_prep"), F.sum("gpm_prep").alias("gpm_prep"), F.count("*").alias("n"), F.min("v_date").alias("day"))
    return by.where(F.col("n") == days_in_month(F.col("day"))).drop("n", "day")


def seasonal_totals(monthly: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Totals by station, year and season of complete months; a season needs not have all of its months."""
    kept = monthly.where(~F.col("v_year").isin(*without)) if without else monthly
    return kept.groupBy("code_wmo", "v_year", season(F.col("v_month")).alias("seasons")).agg(F.sum("inmet_prep").alias("inmet_prep"), F.sum("gpm_prep").alias("gpm_prep"))


def contingency(pairs: DataFrame, by: tuple[str, ...] = (), wet: float = 0.0, thr: float = 0.2, obs: str = "inmet_prep", est: str = "gpm_prep") -> DataFrame:
    """Counts of the four rain classes and of the rows in none, in one pass with partial sums."""
    kind = rain_class(F.col(obs), F.col(est), wet, thr)
    return pairs.groupBy(*by).agg(*[F.count_if(kind == c).alias(c) for c in ("n11", "n01", "n10", "n00", "others")])


def skill_scores(counts: DataFrame, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """POD, FAR, CSI and PC in percent; null where the denominator is 0."""
    n11, n01, n10, n00 = map(F.col, ("n11", "n01", "n10", "n00"))
    scores: dict[str, Column] = {
        "POD": F.try_divide(n11, n11 + n10), "FAR": F.try_divide(n01, n11 + n01), "CSI": F.try_divide(n11, n11 + n01 + n10), "PC": F.try_divide(n11 + n00, n11 + n01 + n10 + n00),
    }
    return counts.select(*by, *[(c * 100 if digits is None else F.round(c * 100, digits)).alias(n) for n, c in scores.items()])
