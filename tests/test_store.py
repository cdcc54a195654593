"""Bucketed tables: joins and groups by their keys need no shuffle, and they follow their inputs."""

import re

import pytest
from pyspark.sql import functions as F

from terrafold import storage
from terrafold.jobs import QUERIES
from terrafold.jobs.common import daily
from terrafold.operators.pairs import monthly_totals, pair

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return [line for line in text.splitlines() if re.search(r"\bExchange\b", line)]


def test_pairs_meet_in_their_buckets(spark, no_broadcast):
    text = plan(QUERIES["pair_obs_est"](spark, SF))
    assert "SortMergeJoin" in text and exchanges(text) == []


@pytest.mark.parametrize("name", ["monthly_totals", "station_months", "scatter_pairs_month"])
def test_months_shuffle_partial_sums_alone(spark, no_broadcast, name):
    """Only what the partial aggregate makes is shuffled: below it there is the scan."""
    lines = plan(QUERIES[name](spark, SF)).splitlines()
    aggregates = [i for i, line in enumerate(lines) if "HashAggregate" in line]
    assert "partial_sum" in lines[aggregates[-1]] and not any(re.search(r"\bExchange\b", line) for line in lines[aggregates[-1] :])


def test_months_of_joined_pairs(spark, no_broadcast):
    text = plan(monthly_totals(pair(*daily(spark, SF))))
    below = text[text.rindex("partial_sum") :]
    assert "SortMergeJoin" in below and exchanges(below) == []


def test_a_table_is_made_once(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    first = storage.bucketed(df, "once_made", ["k"])
    again = storage.bucketed(df.where("false"), "once_made", ["k"])
    assert first.count() == again.count() == 100
    storage.removed(spark, storage._MADE[spark.sparkContext.applicationId, "once_made"])
    assert storage.bucketed(df.where("k = 1"), "once_made", ["k"]).count() == 15


def test_the_state_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    before = storage.state(spark, path)
    assert storage.state(spark, path) == before
    spark.range(5).write.mode("append").parquet(path)
    assert storage.state(spark, path) != before
