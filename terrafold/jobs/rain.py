"""Queries on gauge readings, satellite samples and their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decimal_comma, granule_month, granule_name, granule_start, month_granule_name
from ..operators import pairs as P
from ..operators import readings as R
from ..operators import satellite as S
from ..operators.backfill import load_days, read_days
from ..sources import reading_fields
from ..storage import new_path
from .common import EDGE_YEARS, HALVES, PAIRS, READINGS, daily, daily_store, iso, lines, number, readings, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# Class names, thresholds, seasons and granule names below are fixed values.
KIND = """
  CASE WHEN inmet_prep > 0 AND gpm_prep > 0.2 THEN 'n11' WHEN inmet_prep = 0 AND gpm_prep > 0.2 THEN 'n01'
       WHEN inmet_prep > 0 AND gpm_prep < 0.2 THEN 'n10' WHEN inmet_prep = 0 AND gpm_prep < 0.2 THEN 'n00' ELSE 'others' END"""
COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{c}') AS {c}" for c in ("n11", "n01", "n10", "n00", "others"))


def scores_sql(source: str, where: str, by: str = "", before: str = PAIRS) -> str:
    keys = f"{by}, " if by else ""
    score = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0) * 100, 4)"
    return f"""WITH {before}, k AS (SELECT *, {KIND} AS kind FROM {source} WHERE {where}), c AS (SELECT {keys}{COUNTS} FROM k {"GROUP BY " + by if by else ""})
SELECT {keys}{score("n11", "n11 + n10")} AS "POD", {score("n01", "n11 + n01")} AS "FAR", {score("n11", "n11 + n01 + n10")} AS "CSI", {score("(n11 + n00)", "n11 + n01 + n10 + n00")} AS "PC" FROM c"""


MONTHLY = PAIRS + """,
monthly AS (
  SELECT code_wmo, strftime(v_date, '%Y') AS v_year, strftime(v_date, '%m') AS v_month, sum(inmet_prep) AS inmet_prep, sum(gpm_prep) AS gpm_prep
  FROM pairs GROUP BY 1, 2, 3 HAVING count(*) = day(last_day(min(v_date))))"""
LOWERED = MONTHLY + ", lowered AS (SELECT code_wmo, v_year, v_month, greatest(inmet_prep - 1200, 0) AS inmet_prep, greatest(gpm_prep - 6, 0) AS gpm_prep FROM monthly WHERE v_year <> '2001')"
SEASON = "CASE WHEN v_month IN ('01','02','03') THEN '01_summer' WHEN v_month IN ('04','05','06') THEN '02_autumn' WHEN v_month IN ('07','08','09') THEN '03_winter' ELSE '04_spring' END"
SEASONAL = "seasonal AS (SELECT code_wmo, v_year, {s} AS seasons, sum(inmet_prep) AS inmet_prep, sum(gpm_prep) AS gpm_prep FROM {t} GROUP BY 1, 2, 3)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all station days that the tables have; pair_obs_est makes the same by the join of both sides."""
    return daily_store(spark, sf_dir)


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals less what nearly every month has, so that all rain classes occur."""
    m = P.monthly_totals(paired(spark, sf_dir)).where("v_year <> '2001'")
    return m.withColumn("inmet_prep", F.greatest(F.col("inmet_prep") - 1200, F.lit(0))).withColumn("gpm_prep", F.greatest(F.col("gpm_prep") - 6, F.lit(0)))


def scored(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return P.skill_scores(P.contingency(df, by), by, digits=4)


INNER = "year(v_date) NOT IN (1995, 2001)"


@query(scores_sql("pairs", "true"))
def scores_all(spark, sf_dir):
    return scored(paired(spark, sf_dir))


@query(scores_sql("pairs", INNER, "code_wmo"))
def scores_by_station(spark, sf_dir):
    return scored(P.exclude_years(paired(spark, sf_dir), EDGE_YEARS), ("code_wmo",))


@query(scores_sql("lowered", "true", "v_month", LOWERED))
def scores_by_month(spark, sf_dir):
    return scored(lowered(spark, sf_dir), ("v_month",))


@query(scores_sql("seasonal", "true", "seasons", LOWERED + ", " + SEASONAL.format(s=SEASON, t="lowered")))
def scores_by_season(spark, sf_dir):
    return scored(P.seasonal_totals(lowered(spark, sf_dir)), ("seasons",))


@query(f"WITH {PAIRS}, k AS (SELECT *, {KIND} AS kind FROM pairs WHERE {INNER}) SELECT {COUNTS} FROM k")
def contingency_counts(spark, sf_dir):
    return P.contingency(P.exclude_years(paired(spark, sf_dir), EDGE_YEARS))


@query(f'WITH {PAIRS} SELECT CAST(gpm_prep AS DOUBLE) AS "Estimados", CAST(inmet_prep AS DOUBLE) AS "Observados" FROM pairs WHERE {INNER}')
def scatter_pairs_day(spark, sf_dir):
    return P.scatter_pairs(P.exclude_years(paired(spark, sf_dir), EDGE_YEARS)).select(number("Estimados"), number("Observados"))


@query(f"""WITH {MONTHLY} SELECT CAST(gpm_prep AS DOUBLE) AS "Estimados", CAST(inmet_prep AS DOUBLE) AS "Observados" FROM monthly WHERE v_year <> '2001'""")
def scatter_pairs_month(spark, sf_dir):
    return P.scatter_pairs(P.monthly_totals(paired(spark, sf_dir)).where("v_year <> '2001'")).select(number("Estimados"), number("Observados"))


OBS_EST = "CAST(inmet_prep AS DOUBLE) AS inmet_prep, CAST(gpm_prep AS DOUBLE) AS gpm_prep"


@query(f"WITH {PAIRS} SELECT code_wmo, strftime(v_date, '%Y') AS v_year, strftime(v_date, '%m') AS v_month, strftime(v_date, '%d') AS v_day, {OBS_EST} FROM pairs WHERE {INNER}")
def station_days(spark, sf_dir):
    out = P.station_days(P.exclude_years(paired(spark, sf_dir), EDGE_YEARS))
    return out.select("code_wmo", "v_year", "v_month", "v_day", number("inmet_prep"), number("gpm_prep")).orderBy("code_wmo", "v_year", "v_month", "v_day")


@query(f"WITH {MONTHLY} SELECT code_wmo, v_year, v_month, {OBS_EST} FROM monthly WHERE v_year NOT IN ('1995', '2001')")
def station_months(spark, sf_dir):
    out = P.monthly_totals(P.exclude_years(paired(spark, sf_dir), EDGE_YEARS))
    return out.select("code_wmo", "v_year", "v_month", number("inmet_prep"), number("gpm_prep")).orderBy("code_wmo", "v_year", "v_month")


@query(f"WITH {MONTHLY} SELECT code_wmo, v_year, v_month, {OBS_EST} FROM monthly")
def monthly_totals(spark, sf_dir):
    return P.monthly_totals(paired(spark, sf_dir)).select("code_wmo", "v_year", "v_month", number("inmet_prep"), number("gpm_prep"))


@query(f"WITH {MONTHLY}, m AS (SELECT * FROM monthly WHERE v_year <> '2001'), {SEASONAL.format(s=SEASON, t='m')} SELECT code_wmo, v_year, seasons, {OBS_EST} FROM seasonal")
def seasonal_totals(spark, sf_dir):
    out = P.seasonal_totals(P.monthly_totals(paired(spark, sf_dir)), without=("2001",))
    return out.select("code_wmo", "v_year", "seasons", number("inmet_prep"), number("gpm_prep"))


@query(f"WITH {PAIRS} SELECT code_wmo, CAST(v_date AS VARCHAR) AS v_date, {OBS_EST} FROM pairs")
def pair_obs_est(spark, sf_dir):
    return P.pair(*daily(spark, sf_dir)).select("code_wmo", iso("v_date"), number("inmet_prep"), number("gpm_prep"))


@query(f"WITH {PAIRS} SELECT code_wmo, CAST(v_date AS VARCHAR) AS v_date, CAST(gpm_prep AS DOUBLE) AS prep_mm FROM pairs")
def append_chunks(spark, sf_dir):
    """The chunks are files, one folder a station, written in one pass and read in one; the folder names the station, and one
    without rows has none."""
    path = new_path(spark, "chunks")
    daily(spark, sf_dir)[1].select("code_wmo", "v_date", F.col("prep_mm").cast("decimal(38,2)").alias("prep_mm")).write.partitionBy("code_wmo").parquet(path)
    rows = spark.read.schema("v_date date, prep_mm decimal(38,2), code_wmo string").parquet(path)
    return rows.select("code_wmo", iso("v_date"), number("prep_mm"))


@query(f"WITH {PAIRS} SELECT code_wmo, CAST(v_date AS VARCHAR) AS v_date, {OBS_EST} FROM pairs WHERE v_date BETWEEN DATE '1996-06-01' AND DATE '1998-02-28'")
def date_range(spark, sf_dir):
    return R.between_dates(paired(spark, sf_dir), "1996-06-01", "1998-02-28").select("code_wmo", iso("v_date"), number("inmet_prep"), number("gpm_prep"))


# Readings.


@query("""
SELECT event_id, event_type AS code_wmo, strftime(ts, '%Y-%m-%d %H:%M') AS v_datetime,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS prep_mm
FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0""")
def clean_readings(spark, sf_dir):
    raw = lines(spark, sf_dir).select("event_id", "code_wmo", *reading_fields(F.col("line")))
    out = R.clean_readings(raw.withColumn("code_wmo", F.struct("event_id", "code_wmo")))
    return out.select("code_wmo.event_id", "code_wmo.code_wmo", F.date_format("v_datetime", "yyyy-MM-dd HH:mm").alias("v_datetime"), "prep_mm")


@query("""
SELECT event_id, event_type AS code_wmo, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d') END AS data,
       CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H%M') || ' UTC' ELSE strftime(ts, '%H:%M') END AS hora,
       CASE WHEN event_id % 17 = 0 THEN '-9999' WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'x' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS prep_mm,
       CAST(user_id AS VARCHAR) AS pres_mb, CAST(NULL AS VARCHAR) AS vent_vel_ms
FROM events""")
def parse_reading_lines(spark, sf_dir):
    raw = lines(spark, sf_dir)
    return raw.select("event_id", "code_wmo", *reading_fields(F.col("line"))).select("event_id", "code_wmo", "data", "hora", decimal_comma(F.col("prep_mm")).alias("prep_mm"), "pres_mb", "vent_vel_ms")


HOUR = "strftime(v_datetime, '%Y-%m-%d %H') AS v_datetime"


def hours(df: DataFrame) -> DataFrame:
    return df.select("code_wmo", F.date_format("v_datetime", "yyyy-MM-dd HH").alias("v_datetime"), number("prep_mm"))


@query(f"WITH {READINGS} SELECT code_wmo, {HOUR}, CAST(prep_mm AS DOUBLE) AS prep_mm FROM readings WHERE code_wmo IN (SELECT event_type FROM events GROUP BY 1 HAVING max(value) < 600)")
def restrict_stations(spark, sf_dir):
    """The stations whose highest value is below 600."""
    subset = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code_wmo")).agg(F.max("value").alias("highest")).where("highest < 600")
    return hours(R.restrict_stations(readings(spark, sf_dir), subset))


@query(f"WITH {READINGS}, {HALVES} SELECT code_wmo, CAST(v_date AS VARCHAR) AS v_date FROM halves")
def complete_days(spark, sf_dir):
    return R.complete_days(readings(spark, sf_dir)).select("code_wmo", iso("v_date"))


@query(f"""WITH {PAIRS} SELECT code_wmo, strftime(v_date, '%Y') AS v_year, strftime(v_date, '%m') AS v_month, count(*) AS n_days
FROM pairs GROUP BY 1, 2, 3 HAVING count(*) = day(last_day(min(v_date)))""")
def complete_months(spark, sf_dir):
    return R.complete_months(daily(spark, sf_dir)[0])


@query(f"WITH {READINGS}, {HALVES} SELECT r.code_wmo, {HOUR}, CAST(prep_mm AS DOUBLE) AS prep_mm FROM readings r JOIN halves h ON r.code_wmo = h.code_wmo AND CAST(v_datetime AS DATE) = v_date")
def keep_complete_days(spark, sf_dir):
    df = readings(spark, sf_dir)
    return hours(R.keep_complete_days(df, R.complete_days(df)))


@query(f"WITH {READINGS}, {HALVES} SELECT code_wmo, CAST(v_date AS VARCHAR) AS v_date, CAST(total_prep_mm_12 AS DOUBLE) AS total_prep_mm_12, CAST(total_prep_mm_13 AS DOUBLE) AS total_prep_mm_13 FROM halves")
def half_day_totals(spark, sf_dir):
    return R.half_day_totals(readings(spark, sf_dir)).select("code_wmo", iso("v_date"), number("total_prep_mm_12"), number("total_prep_mm_13"))


@query(f"""WITH {READINGS}, {HALVES} SELECT c.code_wmo, CAST(c.v_date AS VARCHAR) AS v_date, CAST(c.total_prep_mm_12 + p.total_prep_mm_13 AS DOUBLE) AS prep_mm
FROM halves c JOIN halves p ON c.code_wmo = p.code_wmo AND p.v_date = c.v_date - 1""")
def rain_day_totals(spark, sf_dir):
    return R.rain_day_totals(readings(spark, sf_dir)).select("code_wmo", iso("v_date"), number("prep_mm"))


@query("""WITH s AS (SELECT o_custkey AS code_wmo, o_orderkey, year(o_orderdate) AS source_ano FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'),
m AS (SELECT code_wmo, max(source_ano) AS source_ano FROM s GROUP BY 1)
SELECT s.code_wmo, s.o_orderkey, CAST(s.source_ano AS INTEGER) AS source_ano FROM s JOIN m ON s.code_wmo = m.code_wmo AND s.source_ano = m.source_ano""")
def latest_station(spark, sf_dir):
    """The stations of all market segments but one."""
    stations = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code_wmo"), "o_orderkey", F.year("o_orderdate").alias("source_ano"))
    subset = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("code_wmo"))
    return R.latest_station(stations, subset)


@query("""SELECT row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS fid, c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS lon,
CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS lat FROM customer""")
def station_points(spark, sf_dir):
    text = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("string").alias("long"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("lat"))
    return R.station_points(text, "c_custkey").select("fid", "c_custkey", "point.lon", "point.lat")


# Satellite.

DAYS = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS v_date FROM events)"
SLOTS = "slots AS (SELECT v_date, unnest(generate_series(CAST(v_date AS TIMESTAMP) - INTERVAL 12 HOUR, CAST(v_date AS TIMESTAMP) + INTERVAL 690 MINUTE, INTERVAL 30 MINUTE)) AS start FROM days)"
NAME = "'3B-HHR-L.MS.MRG.3IMERG.' || strftime({s}, '%Y%m%d') || '-S' || strftime({s}, '%H%M%S') || '-E' || strftime({s} + INTERVAL 1799 SECOND, '%H%M%S') || '.' || lpad(CAST(hour({s}) * 60 + minute({s}) AS VARCHAR), 4, '0') || '.V06B.30min'"
SLOT_OF = "time_bucket(INTERVAL 30 MINUTE, ts)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("v_date")).distinct()


def slot_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    half = F.when(F.minute(ts) < 30, F.expr("interval 0 minutes")).otherwise(F.expr("interval 30 minutes"))
    return table(spark, sf_dir, "events").select((F.date_trunc("hour", ts).cast("timestamp_ntz") + half).alias("start")).distinct()


@query(f"WITH {DAYS}, {SLOTS} SELECT CAST(v_date AS VARCHAR) AS v_date, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(start + INTERVAL 1799 SECOND, '%Y-%m-%d %H:%M:%S') AS \"end\", {NAME.format(s='start')} AS granule FROM slots")
def granule_calendar(spark, sf_dir):
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")]
    return S.granule_calendar(days(spark, sf_dir)).select(iso("v_date"), *text, "granule")


@query(f"WITH s AS (SELECT DISTINCT {SLOT_OF} AS start FROM events) SELECT {NAME.format(s='start')} AS granule, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM s")
def granule_names(spark, sf_dir):
    named = slot_starts(spark, sf_dir).select(granule_name(F.col("start")).alias("granule"))
    return named.select("granule", F.date_format(granule_start(F.col("granule")), "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("""WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT '3B-MO-GIS.MS.MRG.3IMERG.' || CAST(y AS VARCHAR) || lpad(CAST(m AS VARCHAR), 2, '0') || '01-S000000-E235959.' || lpad(CAST(m AS VARCHAR), 2, '0') || '.V06B.total.accum.tif' AS granule,
CAST(y AS VARCHAR) AS v_year, lpad(CAST(m AS VARCHAR), 2, '0') AS v_month FROM m""")
def month_granule_names(spark, sf_dir):
    """Names of the monthly rasters of all months, and the years and months read back from them."""
    months = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    named = months.select(month_granule_name(F.col("y"), F.col("m")).alias("granule"))
    year, month = granule_month(F.col("granule"))
    return named.select("granule", year.alias("v_year"), month.alias("v_month"))


SATELLITE_DAILY = f"""WITH {DAYS}, s AS (SELECT event_type AS id, CAST(ts + INTERVAL 12 HOUR AS DATE) AS v_date, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
i AS (SELECT DISTINCT event_type AS id FROM events)
SELECT i.id, CAST(days.v_date AS VARCHAR) AS v_date, round(coalesce(CAST(v AS DOUBLE) / 10, 0), 4) AS total_mm FROM i CROSS JOIN days LEFT JOIN s ON s.id = i.id AND s.v_date = days.v_date"""


def satellite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("decimal(18,2)").alias("value"))


@query(SATELLITE_DAILY)
def satellite_daily(spark, sf_dir):
    samples = satellite_samples(spark, sf_dir)
    return S.satellite_daily(samples, samples.select("id").distinct(), days(spark, sf_dir)).select("id", iso("v_date"), number("total_mm"))


@query(SATELLITE_DAILY)
def resumed_load(spark, sf_dir):
    """Daily totals loaded by day, in two goes: the days of even number, then all, of which the first half is there already."""
    path, samples = new_path(spark, "days"), satellite_samples(spark, sf_dir)
    rows_of = lambda part: S.satellite_daily(samples, samples.select("id").distinct(), part).select("id", F.col("total_mm").cast("double").alias("total_mm"), "v_date")
    for part in (days(spark, sf_dir).where("day(v_date) % 2 = 0"), days(spark, sf_dir)):
        load_days(spark, path, part, rows_of)
    return read_days(spark, path, "id string, total_mm double, v_date date").select("id", iso("v_date"), number("total_mm"))


GRANULES = f"""px AS (SELECT {SLOT_OF} AS start, user_id // 30 % 20 AS row_, user_id % 30 AS col_, sum(CAST(value AS DECIMAL(18,2))) AS value FROM events GROUP BY 1, 2, 3)"""
#: A grid of 20 rows of 30 pixels; stations lie on its left part, and some below it.
GRID = {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": -1.0, "width": 30, "height": 20}


@query(f"""WITH {DAYS}, {GRANULES}, st AS (SELECT c_custkey AS id, c_custkey % 14 AS col_, c_custkey // 14 % 25 AS row_ FROM customer),
s AS (SELECT id, CAST(start + INTERVAL 12 HOUR AS DATE) AS v_date, sum(value) AS v FROM st JOIN px USING (row_, col_) GROUP BY 1, 2)
SELECT st.id, CAST(days.v_date AS VARCHAR) AS v_date, round(coalesce(CAST(v AS DOUBLE) / 10, 0), 4) AS total_mm FROM st CROSS JOIN days LEFT JOIN s ON s.id = st.id AND s.v_date = days.v_date""")
def station_rain(spark, sf_dir):
    """Granules of events (a pixel for each user) written by day and tile, sampled at all customers, summed by day."""
    half = F.window(F.col("ts").cast("timestamp_ntz"), "30 minutes")["start"]
    user = F.col("user_id")
    px = table(spark, sf_dir, "events").groupBy(half.alias("start"), (F.floor(user / 30) % 20).cast("int").alias("row"), (user % 30).cast("int").alias("col")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("value"))
    path = new_path(spark, "granules")
    S.write_granules(px, path, GRID)
    granules = spark.read.schema("start timestamp_ntz, row int, col int, value decimal(38,2), v_date date, tile int").parquet(path)
    k = F.col("c_custkey")
    stations = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 14 + 0.25).alias("lon"), (-(F.floor(k / 14) % 25) - 0.25).alias("lat"))
    return S.station_rain(granules, stations, days(spark, sf_dir), GRID).select("id", iso("v_date"), number("total_mm"))


@query(f"WITH {DAYS}, {SLOTS}, p AS (SELECT DISTINCT {SLOT_OF} AS start FROM events) SELECT CAST(v_date AS VARCHAR) AS v_date, 'missing granule ' || {NAME.format(s='slots.start')} AS message FROM slots WHERE start NOT IN (SELECT start FROM p)")
def missing_granules(spark, sf_dir):
    present = slot_starts(spark, sf_dir).select(granule_name(F.col("start")).alias("granule"))
    return S.missing_granules(S.granule_calendar(days(spark, sf_dir)), present).select(iso("v_date"), "message")
