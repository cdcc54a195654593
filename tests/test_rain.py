from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from terrafold.functions import granule_month, granule_name, month_granule_name, season
from terrafold.operators import pairs as P
from terrafold.operators import readings as R
from terrafold.operators import satellite as S


def pairs(spark, rows):
    return spark.createDataFrame(rows, "inmet_prep double, gpm_prep double")


def hours(spark, days, value=1.0, keep=lambda h: True):
    rows = [("a", datetime(2019, 1, d, h), value) for d in days for h in range(24) if keep(h)]
    return spark.createDataFrame(rows, "code_wmo string, v_datetime timestamp_ntz, prep_mm double")


def test_scores_of_one_of_each(spark):
    counts = P.contingency(pairs(spark, [(1.0, 1.0), (0.0, 1.0), (1.0, 0.1), (0.0, 0.1)]))
    assert counts.first()[:5] == (1, 1, 1, 1, 0)
    assert tuple(P.skill_scores(counts, digits=2).first()) == (50.0, 50.0, 33.33, 50.0)


def test_scores_leave_others_out(spark):
    rows = [(1.0, 0.2), (0.0, 0.2), (-1.0, 5.0), (None, 5.0), (1.0, None)]
    assert P.contingency(pairs(spark, rows)).first()[:5] == (0, 0, 0, 0, 5)


def test_scores_without_denominator(spark):
    assert tuple(P.skill_scores(P.contingency(pairs(spark, [(0.0, 0.1)]))).first()) == (None, None, None, 100.0)


def test_complete_days_have_exactly_24_rows(spark):
    rows = [("a", datetime(2019, 1, d, min(h, 23)), 1.0) for d, n in ((1, 23), (2, 24), (3, 25)) for h in range(n)]
    days = R.complete_days(spark.createDataFrame(rows, "code_wmo string, v_datetime timestamp_ntz, prep_mm double"))
    assert [r.v_date for r in days.collect()] == [date(2019, 1, 2)]


def test_rain_day(spark):
    out = R.rain_day_totals(hours(spark, (1, 2))).collect()
    assert [(r.v_date, r.prep_mm) for r in out] == [(date(2019, 1, 2), 24.0)]
    assert R.rain_day_totals(hours(spark, (1, 3))).count() == 0
    assert R.rain_day_totals(hours(spark, (1, 2)), first="2019-01-02").count() == 0


def test_rain_day_equals_the_self_join(spark):
    df = hours(spark, (1, 2, 3, 5, 6), value=2.5)
    half = R.half_day_totals(df)
    p = half.select(F.date_add("v_date", 1).alias("v_date"), "code_wmo", F.col("total_prep_mm_13").alias("late"))
    joined = half.join(p, ["code_wmo", "v_date"]).select("code_wmo", "v_date", (F.col("total_prep_mm_12") + F.col("late")).alias("prep_mm"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, R.rain_day_totals(df).collect()))


def test_rain_day_with_an_empty_half_is_null(spark):
    late = [("a", datetime(2019, 1, 2, 13), 1.0)] * 24
    rows = [("a", datetime(2019, 1, 1, h), 1.0) for h in range(24)] + late
    out = R.rain_day_totals(spark.createDataFrame(rows, "code_wmo string, v_datetime timestamp_ntz, prep_mm double"))
    assert out.first().prep_mm is None


def test_complete_months(spark):
    rows = [(c, date(y, 2, 1) + timedelta(i)) for c, y, n in (("a", 2019, 28), ("b", 2020, 28), ("c", 2020, 29)) for i in range(n)]
    out = R.complete_months(spark.createDataFrame(rows, "code_wmo string, v_date date"))
    assert sorted(r.code_wmo for r in out.collect()) == ["a", "c"]


def test_season_of_one_month_stays(spark):
    rows = [("a", date(2019, 4, 1) + timedelta(i), Decimal(1), Decimal(2)) for i in range(30)]
    df = spark.createDataFrame(rows, "code_wmo string, v_date date, inmet_prep decimal(18,2), gpm_prep decimal(18,2)")
    assert [(r.seasons, r.inmet_prep) for r in P.seasonal_totals(P.monthly_totals(df)).collect()] == [("02_autumn", 30)]
    assert spark.range(1).select(season(F.lit("13"))).first()[0] == "others"


def test_clean_readings(spark):
    rows = [("a", "2019/01/01", "0100 UTC", "-9999"), ("a", "2019/01/01", "0100 UTC", ""), ("a", "2019/01/01", "0100 UTC", ",8"), ("a", "2018-12-31", "23:00", "x"), ("a", "2018-12-31", "23:00", None)]
    out = R.clean_readings(spark.createDataFrame(rows, "code_wmo string, data string, hora string, prep_mm string")).collect()
    assert [(r.v_datetime, r.prep_mm) for r in out] == [(datetime(2019, 1, 1, 1), 0.8), (datetime(2018, 12, 31, 23), None)]


def test_latest_station_keeps_ties(spark):
    st = spark.createDataFrame([("a", 2018), ("a", 2019), ("a", 2019), ("b", 2019)], "code_wmo string, source_ano int")
    out = R.latest_station(st, spark.createDataFrame([("a",)], "code_wmo string"))
    assert sorted(map(tuple, out.collect())) == [("a", 2019), ("a", 2019)]


def test_satellite_window(spark):
    at = [datetime(2019, 1, 1, 11, 30), datetime(2019, 1, 1, 12), datetime(2019, 1, 2, 11, 30), datetime(2019, 1, 2, 12)]
    samples = spark.createDataFrame([("a", t, 10.0) for t in at], "id string, ts timestamp_ntz, value double")
    stations = spark.createDataFrame([("a",), ("b",)], "id string")
    out = S.satellite_daily(samples, stations, spark.createDataFrame([(date(2019, 1, 2),)], "v_date date"))
    assert sorted((r.id, r.total_mm) for r in out.collect()) == [("a", 2.0), ("b", 0.0)]


def test_monthly_granules(spark):
    df = spark.createDataFrame([(2006, 1), (2019, 12)], "y int, m int")
    named = df.select(month_granule_name(F.col("y"), F.col("m")).alias("g"))
    # Fixed value.
    assert named.first().g == "3B-MO-GIS.MS.MRG.3IMERG.20060101-S000000-E235959.01.V06B.total.accum.tif"
    assert sorted(tuple(r) for r in named.select(*granule_month(F.col("g"))).collect()) == [("2006", "01"), ("2019", "12")]
    assert tuple(spark.range(1).select(*granule_month(F.lit("other.tif"))).first()) == (None, None)
    other = granule_name(F.lit("2020-01-01 00:00").cast("timestamp_ntz"), "3B-HHR-E", "V07A")
    # Fixed value.
    assert spark.range(1).select(other).first()[0] == "3B-HHR-E.MS.MRG.3IMERG.20200101-S000000-E002959.0000.V07A.30min"


def test_row_ids(spark):
    df = spark.createDataFrame([(k, "1.5", "x") for k in ["a", "b", None, "a", ""] + [f"s{i}" for i in range(500)]], "code string, long string, lat string")
    rows = R.station_points(df, "code").collect()
    assert sorted(r.fid for r in rows) == list(range(1, 506)) and all(r.point.lon == 1.5 and r.point.lat is None for r in rows)
    assert R.station_points(df.limit(0), "code").count() == 0 and "fid" not in R.station_points(df).columns


def test_granules(spark):
    # A fixed value.
    one = spark.createDataFrame([(datetime(2006, 12, 22, 10),)], "t timestamp_ntz").select(granule_name(F.col("t"))).first()[0]
    assert one == "3B-HHR-L.MS.MRG.3IMERG.20061222-S100000-E102959.0600.V06B.30min"
    calendar = S.granule_calendar(spark.createDataFrame([(date(2019, 1, 2),)], "v_date date"))
    assert calendar.count() == 48
    assert S.missing_granules(calendar, calendar.orderBy("start").limit(47)).count() == 1
