"""Registered queries: operators applied to whole tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, land, rain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**rain.QUERIES, **land.QUERIES, **files.QUERIES}
ORACLE_SQL: dict[str, str] = {**rain.ORACLE_SQL, **land.ORACLE_SQL, **files.ORACLE_SQL}
