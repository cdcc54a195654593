from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import terrafold.sources as sources
from terrafold import storage
from terrafold.sources.lines import file_lines
from terrafold.streaming import satellite_daily_stream


def test_station_files(spark, tmp_path):
    head = ["REGIAO:;CO", "UF:;DF", "ESTACAO:;BRASÍLIA", "CODIGO:;A001", "LATITUDE:;-15,79", "LONGITUDE:;-47,93", "ALTITUDE:;1159,54", "DATA:;07/05/00", "Data;Hora;Prep"]
    body = ["2019/01/01;0000 UTC;,8;887,1", "2019/01/01;0100 UTC;-9999;" + ";".join("1" * 20)]
    (tmp_path / "INMET_A001_2018-2019.CSV").write_bytes("\r\n".join(head + body).encode("latin-1"))
    stations, readings = sources.read_station_files(spark, str(tmp_path))
    s = stations.first()
    assert (s.source_ano, s.estacao, s.code_wmo, s.lat, s.alt) == (2019, "BRASÍLIA", "A001", -15.79, 1159.54)
    # Rows come in no order.
    rows = sorted(readings.collect(), key=lambda r: r.hora)
    assert len(readings.columns) == 21 and [(r.prep_mm, r.pres_mb, r.vent_vel_ms) for r in rows] == [(".8", "887.1", None), ("-9999", "1", "1")]


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of 2,000 bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_station_files_in_parts(spark, tmp_path, small_parts):
    """Several files of many parts, one of the head alone, one empty: facts meet their own rows, none is lost or twice."""
    for f, n in (("a_2001", 900), ("b_2002", 500), ("c_2003", 0)):
        head = ["REGIAO:;CO", "UF:;DF", f"ESTACAO:;É{f}", f"CODIGO:;{f}", "LATITUDE:;-15,79", "LONGITUDE:;-47,93", "ALTITUDE:;1,5", "DATA:;x", "Data;Hora;Prep"]
        body = [f"2019/01/01;{i:04d} UTC;{i},5" + ("" if i % 7 else "\r\n ") for i in range(n)]
        (tmp_path / f"{f}.CSV").write_bytes("\r\n".join(head + body).encode("latin-1"))
    (tmp_path / "d_2004.CSV").write_bytes(b"")
    stations, readings = sources.read_station_files(spark, str(tmp_path))
    assert {(r.source, r.source_ano, r.estacao, r.code_wmo) for r in stations.collect()} == {(f, int(f[2:]), f"É{f}", f) for f in ("a_2001", "b_2002", "c_2003")}
    assert sorted((r.source, r.code_wmo, r.hora, r.prep_mm) for r in readings.collect()) == sorted((f, f, f"{i:04d} UTC", f"{i}.5") for f, n in (("a_2001", 900), ("b_2002", 500)) for i in range(n))


@pytest.mark.parametrize("wide", [1, 7, 400])
def test_text_grid_in_parts(spark, tmp_path, small_parts, wide):
    """A grid of 40 by 33 numbers, broken into lines of any width with empty ones between, in many parts and in two files."""
    for name, factor in (("one", 1), ("two", -1)):
        numbers = [f"{factor * i + 0.25:.2f}" for i in range(40 * 33)]
        lines = [" ".join(numbers[i : i + wide]) for i in range(0, len(numbers), wide)]
        (tmp_path / f"{name}.GRD").write_text("  \n -90 105 0 320 5 10 \n" + "\n  \n".join(lines) + "\n\n")
    grid = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.GRD", 1)
    got = {(r.grid, r.lon, r.lat): r.height for r in sources.read_text_grid(spark, str(tmp_path), grid=grid).collect()}
    want = {(g, c * 10.0 - 360 if c * 10 > 180 else c * 10.0, 105 - r * 5.0): f * (33 * r + c) + 0.25 for g, f in (("one", 1), ("two", -1)) for r in range(40) for c in range(32)}
    assert got == want


def test_lines_are_told_by_parts(spark, tmp_path, small_parts):
    (tmp_path / "x.txt").write_text("".join(f"{i:05d}\n" for i in range(3000)))
    rows = file_lines(spark, str(tmp_path), weigh=int).collect()
    by_part = {}
    for r in rows:
        by_part.setdefault(r.start, []).append((r.number, r.before, int(bytes(r.line))))
    assert len(by_part) >= 8 and len(rows) == 3000
    for part in by_part.values():
        part.sort()
        values = [v for _, _, v in part]
        assert [n for n, _, _ in part] == list(range(len(part))) and values == list(range(values[0], values[0] + len(values)))
        assert [b for _, b, _ in part] == [sum(values[:i]) for i in range(len(values))]


def test_points_and_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5)], "id string, lat double, long double")
    sources.write_delimited(df, str(tmp_path / "p"))
    assert sources.read_points(spark, str(tmp_path / "p")).collect() == df.collect()


def test_nothing_is_overwritten_unasked(spark, tmp_path):
    df = spark.range(1)
    for write in (sources.write_delimited, lambda d, p, mode="errorifexists": sources.save(d, "kept", p, mode)):
        path = str(tmp_path / str(id(write)))
        write(df, path)
        with pytest.raises(AnalysisException):
            write(df, path)
        write(df, path, mode="overwrite")


def test_the_shared_folder_must_be_shared(spark, monkeypatch):
    assert storage.shared_dir(spark)
    path = storage.new_path(spark, "x")
    spark.range(3).write.parquet(path)
    storage.removed(spark, path)
    spark.range(1).write.parquet(path)

    class Elsewhere:
        def __init__(self):
            self.conf, self.sparkContext = self, self

        master = "spark://host:7077"

        def get(self, *_):
            return None

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def isEmpty(self):
            return True

    with pytest.raises(RuntimeError):
        storage.shared_dir(Elsewhere())


def test_save(spark, tmp_path):
    sources.save(spark.range(3).toDF("x"), "saved", str(tmp_path / "s"))
    assert spark.sql("select sum(x) from saved").first()[0] == 3


def test_band_csvs(spark, tmp_path):
    (tmp_path / "north.csv").write_text("band1,band2\n1,2\n3,4\n")
    rows = sources.read_band_csvs(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, "north"), (3, 4, "north")]


def test_text_grid(spark, tmp_path):
    (tmp_path / "g.txt").write_text("-90 90 0 360 90 90\n1 2 3 4 5\n\n6 7 8 9 10\n11 12 13\n14 15\n")
    rows = sources.read_text_grid(spark, str(tmp_path / "g.txt")).collect()
    assert len(rows) == 12 and {(r.lon, r.lat): r.height for r in rows}[(-90.0, 0.0)] == 9.0


def test_pixels_from_parquet(spark, tmp_path):
    spark.createDataFrame([(1.0,), (29999.0,), (float("nan"),)], "value double").write.parquet(str(tmp_path / "px"))
    assert sorted(r.value for r in sources.pixels_from_parquet(spark, str(tmp_path / "px"), 29999.0).where(F.col("value").isNotNull()).collect()) == [1.0]


def test_daily_totals_on_a_stream(spark, tmp_path):
    rows = [("a", datetime(2019, 1, 1, 12), 10.0), ("a", datetime(2019, 1, 2, 11, 30), 10.0), ("a", datetime(2019, 1, 2, 12), 10.0)]
    schema = "id string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = satellite_daily_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.v_date), r.total_mm) for r in spark.table("daily").collect()) == [("2019-01-02", 2.0), ("2019-01-03", 1.0)]
