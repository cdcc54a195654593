"""Queries on pixel tables, land cover, trends and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import landcover as L
from ..operators import pixels as X
from ..operators import trend as T
from ..operators.clip import RINGS, clip_to_regions as clip
from .common import CATALOG, HITS, PART, POINTS, catalog, number, part_raster, points, table, tiles

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


TILES = "tiles AS (SELECT (row_ // 10) || '_' || (col_ // 10) AS raster_id, row_ % 10 AS row_, col_ % 10 AS col_, value FROM px)"
SAMPLES = f"{CATALOG}, {POINTS}, {HITS}, {TILES}, samples AS (SELECT point_id, h.raster_id, value AS pixel_value FROM hits h JOIN tiles t ON t.raster_id = h.raster_id AND row_ = CAST(trunc(y0 - y) AS INTEGER) AND col_ = CAST(trunc(x - x0) AS INTEGER))"


@query(f"WITH {CATALOG}, {POINTS}, {HITS} SELECT point_id, raster_id FROM hits")
def points_in_extents(spark, sf_dir):
    return X.points_in_extents(points(spark, sf_dir), catalog(spark, sf_dir)).select("point_id", "raster_id")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sample_at_points(points(spark, sf_dir), catalog(spark, sf_dir), tiles(spark, sf_dir))


@query(f"WITH {SAMPLES} SELECT point_id, raster_id, pixel_value FROM samples")
def sample_at_points(spark, sf_dir):
    return samples_of(spark, sf_dir)


@query(f"WITH {SAMPLES} SELECT p.point_id, x, y, pixel_value AS height FROM points p LEFT JOIN samples USING (point_id)")
def attach_value(spark, sf_dir):
    return X.attach_value(points(spark, sf_dir), samples_of(spark, sf_dir), "height").select("point_id", "x", "y", "height")


@query(f"WITH {SAMPLES} SELECT (SELECT count(*) FROM points) AS n_points, (SELECT count(*) FROM catalog) AS n_images, (SELECT count(*) FROM samples) AS n_hits")
def sampling_report(spark, sf_dir):
    return X.sampling_report(points(spark, sf_dir), catalog(spark, sf_dir), samples_of(spark, sf_dir))


@query(f"WITH {PART} SELECT row_ AS \"row\", col_ AS col, value AS band1, CASE WHEN class_id % 7 <> 0 THEN CAST(class_id AS DOUBLE) END AS band2 FROM px")
def stack_bands(spark, sf_dir):
    px = part_raster(spark, sf_dir)
    second = px.where("class_id % 7 <> 0").select("row", "col", F.lit(2).alias("band"), F.col("class_id").cast("double").alias("value"))
    return X.stack_bands(px.select("row", "col", F.lit(1).alias("band"), "value").unionByName(second), (1, 2))


@query(f"WITH {PART} SELECT row_ AS \"row\", col_ AS col, value, class_id FROM px WHERE class_id <> 20 AND class_id IS NOT NULL")
def valid_pixels(spark, sf_dir):
    return X.valid_pixels(part_raster(spark, sf_dir), {"class_id": 20.7, "value": None}).drop("raster_id")


@query(f"WITH {PART} SELECT row_ AS \"row\", col_ AS col, class_id, CASE WHEN class_id IN (20, 36, 39, 41) THEN value END AS value FROM px")
def mask_by_class(spark, sf_dir):
    return X.mask_by_class(part_raster(spark, sf_dir), "value", "class_id").drop("raster_id")


@query(f"WITH {PART} SELECT row_ AS \"row\", col_ AS col, CASE WHEN class_id <> 7 THEN CAST(class_id AS DOUBLE) END AS class_id FROM px")
def nodata_to_null(spark, sf_dir):
    return X.nodata_to_null(part_raster(spark, sf_dir), "class_id", 7).select("row", "col", F.col("class_id").cast("double").alias("class_id"))


DESCRIBE = """SELECT l_returnflag AS name, '{0}' AS band, count({0}) AS n, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, min({0}) AS min,
round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.75), 4) AS q75, max({0}) AS max, count(l_quantity) * 900.0::DOUBLE AS area FROM lineitem GROUP BY 1"""


@query(" UNION ALL ".join(DESCRIBE.format(c) for c in ("l_quantity", "l_extendedprice")))
def describe_area(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), "l_quantity", "l_extendedprice")
    return X.describe_area(rows, "name", ("l_quantity", "l_extendedprice")).withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query(f"""WITH {POINTS}, e AS (SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM points)
SELECT minx - (minx - 0.1 - 0.25 * floor((minx - 0.1) / 0.25)) AS "left", maxx - (maxx - 0.1 - 0.25 * floor((maxx - 0.1) / 0.25)) + 0.25 AS "right",
round(maxy - (maxy - 50.2 - -0.25 * floor((maxy - 50.2) / -0.25)), 4) AS top, round(miny - (miny - 50.2 - -0.25 * floor((miny - 50.2) / -0.25)) - 0.25, 4) AS bottom FROM e""")
def extent_snap(spark, sf_dir):
    return X.snap_extent(X.extent(points(spark, sf_dir)), 0.1, 0.25, 50.2, -0.25).select("left", "right", number("top"), number("bottom"))


@query("""WITH a AS (SELECT 'a_' || CAST(p_partkey AS VARCHAR) || '_dsm' AS raster_id, p_partkey AS k, p_retailprice AS sx FROM part),
b AS (SELECT s_suppkey AS k, s_acctbal AS x0, (s_nationkey + 1) * -0.5 AS y0 FROM supplier)
SELECT raster_id, sx, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0 FROM a JOIN b USING (k)""")
def align_origin(spark, sf_dir):
    """Images of all parts with the origins of those suppliers' images that have the same number; the other parts have no partner."""
    tile = lambda name, key: F.concat(F.lit(name + "_"), F.col(key).cast("string"), F.lit("_dsm" if name == "a" else "_hgt")).alias("raster_id")
    a = table(spark, sf_dir, "part").select(tile("a", "p_partkey"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_retailprice").alias("sx"))
    b = table(spark, sf_dir, "supplier").select(tile("b", "s_suppkey"), F.col("s_acctbal").alias("x0"), ((F.col("s_nationkey") + 1) * -0.5).alias("y0"))
    return X.align_origin(a, b, F.regexp_replace("raster_id", r"^[a-z]_(\d+)_.*$", "$1")).select("raster_id", "sx", "x0", "y0")


@query("""WITH g AS (SELECT vec_id, unnest(embedding) AS height, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
p AS (SELECT vec_id, height, pos // 16 AS i, pos % 16 AS j FROM g WHERE pos % 16 < 15)
SELECT vec_id, CAST(CASE WHEN j * 24 > 180 THEN (j * 24 + 180) % 360 - 180 ELSE j * 24 END AS DOUBLE) AS lon, CAST(90 - i * 60 AS DOUBLE) AS lat, CAST(height AS DOUBLE) AS height FROM p""")
def unflatten_grid(spark, sf_dir):
    header = {"north": 90.0, "west": 0.0, "n_s": 60.0, "e_w": 24.0}
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid"), F.posexplode("embedding").alias("pos", "height"))
    out = X.unflatten_grid(flat.withColumns({k: F.lit(v) for k, v in header.items()}), 16)
    return out.select(F.col("grid").alias("vec_id"), "lon", "lat", F.col("height").cast("double").alias("height"))


# Land cover.

YEARLY = "yearly AS (SELECT l_partkey AS pixel, year(l_shipdate) AS year, max(l_linenumber) AS class_id FROM lineitem GROUP BY 1, 2)"
GROUPS = "groups AS (SELECT * FROM (VALUES ('A', 1), ('A', 2), ('A', 3), ('A', 4), ('B', 5), ('B', 6), ('B', 7)) t(\"group\", class_id))"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pixel"), F.year("l_shipdate").alias("year")).agg(F.max("l_linenumber").alias("class_id"))


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A" if i < 5 else "B", i) for i in range(1, 8)], "group string, class_id int")


@query(f"WITH {YEARLY}, {GROUPS} SELECT pixel, CAST(year AS INTEGER) AS year, class_id, \"group\" FROM yearly JOIN groups USING (class_id)")
def remap_classes(spark, sf_dir):
    return L.remap_classes(yearly(spark, sf_dir), groups(spark)).select("pixel", "year", "class_id", "group")


@query(f"""WITH {YEARLY}, {GROUPS} SELECT pixel, "group", count(*) AS n_years, CAST(CASE WHEN count(*) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS stable,
CAST(CASE WHEN count(*) < 4 THEN 1 ELSE 0 END AS INTEGER) AS not_stable FROM yearly JOIN groups USING (class_id) GROUP BY 1, 2""")
def class_stability(spark, sf_dir):
    return L.class_stability(yearly(spark, sf_dir), groups(spark), keys=("pixel",), min_years=4).drop("longest_run")


@query(f"""WITH {GROUPS}, y AS (SELECT DISTINCT l_partkey AS pixel, year(l_shipdate) AS year, "group" FROM lineitem JOIN groups ON l_linenumber = class_id),
i AS (SELECT *, year - row_number() OVER (PARTITION BY pixel, "group" ORDER BY year) AS island FROM y),
r AS (SELECT pixel, "group", island, count(*) AS run FROM i GROUP BY 1, 2, 3)
SELECT pixel, "group", CAST(sum(run) AS BIGINT) AS n_years, CAST(max(run) AS INTEGER) AS longest_run, CAST(CASE WHEN sum(run) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS stable,
CAST(CASE WHEN sum(run) < 4 THEN 1 ELSE 0 END AS INTEGER) AS not_stable FROM r GROUP BY 1, 2""")
def class_runs(spark, sf_dir):
    """Years and longest runs of years with a class of the group; a pixel has many rows a year."""
    px = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pixel"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("class_id"))
    return L.class_stability(px, groups(spark), keys=("pixel",), min_years=4)


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def region_filter(spark, sf_dir):
    region = table(spark, sf_dir, "region").where(F.col("r_name") == "ASIA")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


# Trends.

SERIES = """
v AS (SELECT p_brand AS brand, strftime(l_shipdate, '%m') AS month, CAST(year(l_shipdate) AS INTEGER) AS year, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
images AS (SELECT month, count(DISTINCT year) AS n_images FROM v GROUP BY 1),
whole AS (SELECT brand, month, count(*) AS n, count(*) = max(n_images) AS complete FROM v JOIN images USING (month) GROUP BY 1, 2),
r AS (SELECT brand, month, n, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY brand, month ORDER BY year) AS i FROM v JOIN whole USING (brand, month) WHERE complete),
ties AS (SELECT brand, month, sum((t - 1) * (2 * t + 5) * t) AS tie FROM (SELECT brand, month, v, count(*) AS t FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
ij AS (SELECT a.brand, a.month, sign(b.v - a.v) AS sg, (b.v - a.v) / (b.i - a.i) AS sl FROM r a JOIN r b ON a.brand = b.brand AND a.month = b.month AND a.i < b.i),
st AS (SELECT brand, month, CAST(sum(sg) AS DOUBLE) AS s, median(sl) AS slope FROM ij GROUP BY 1, 2),
mk AS (
  SELECT w.brand, w.month, CAST(w.n AS INTEGER) AS n, CASE WHEN complete THEN s END AS s, (n * (n - 1) * (2 * n + 5) - tie) / 18.0::DOUBLE AS var_s, slope,
         (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tie) / 18.0::DOUBLE) AS z
  FROM whole w LEFT JOIN st USING (brand, month) LEFT JOIN ties USING (brand, month)),
sig AS (SELECT brand, month, n, s IS NOT NULL AS known, CASE WHEN abs(z) >= 1.959963984540054 THEN s END AS s, CASE WHEN abs(z) >= 1.959963984540054 THEN slope END AS slope FROM mk)"""


def trend_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    rows = line.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    px = rows.groupBy("brand", F.date_format("l_shipdate", "MM").alias("month"), F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    images = px.groupBy("month").agg(F.countDistinct("year").alias("n_images"))
    return T.mann_kendall(px, ["brand", "month"], "year", "value", images)


@query(f"WITH {SERIES} SELECT brand, month, n, s, round(var_s, 4) AS var_s, round(z, 4) AS z, round(slope, 4) AS slope FROM mk")
def mann_kendall(spark, sf_dir):
    return trend_of(spark, sf_dir).select("brand", "month", "n", "s", number("var_s"), number("z"), number("slope"))


@query(f"WITH {SERIES} SELECT brand, month, n, s, round(slope, 4) AS slope FROM sig")
def significant_trend(spark, sf_dir):
    return T.mask_significant(trend_of(spark, sf_dir)).select("brand", "month", "n", "s", number("slope"))


REDUCED = """
red AS (
  SELECT brand, CAST(CASE WHEN count(slope) = 0 AND count(*) FILTER (WHERE known) = 0 THEN 0 WHEN count(slope) = 0 THEN 1
         WHEN count(*) FILTER (WHERE slope < 0) = count(slope) THEN 2 WHEN count(*) FILTER (WHERE slope = 0) = count(slope) THEN 3
         WHEN count(*) FILTER (WHERE slope > 0) = count(slope) THEN 4 ELSE 5 END AS INTEGER) AS trend_class FROM sig GROUP BY 1)"""


def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reduce_trend(T.mask_significant(trend_of(spark, sf_dir)), ["brand"])


@query(f"WITH {SERIES}, {REDUCED} SELECT brand, trend_class FROM red")
def reduce_trend(spark, sf_dir):
    return reduced(spark, sf_dir)


HEIGHT = "CAST((SELECT max(row_) + 1 FROM px) AS DOUBLE)"


@query(f"""WITH {SERIES}, {REDUCED}, {PART},
cells AS (SELECT r, c, trend_class FROM (SELECT DISTINCT row_ // 8 AS r, col_ // 8 AS c FROM px) x JOIN red ON CAST(regexp_extract(brand, '[0-9]+') AS INTEGER) = (5 * r + c) % 25 + 1)
SELECT row_ AS "row", col_ AS col, CAST(CASE WHEN class_id % 5 <> 0 AND coalesce(trend_class, 0) <> 0 THEN 10 * (class_id % 5) + trend_class ELSE 0 END AS INTEGER) AS code
FROM px LEFT JOIN cells ON row_ // 8 = r AND col_ // 8 = c""")
def overlay_code(spark, sf_dir):
    px = part_raster(spark, sf_dir)
    fine = px.select("row", "col", (F.col("class_id") % 5).alias("class_id"))
    # A cell of 8 by 8 pixels has the trend of one brand; the cells cover the whole raster.
    cells = px.select(F.floor(F.col("row") / 8).cast("int").alias("row"), F.floor(F.col("col") / 8).cast("int").alias("col")).distinct()
    of = reduced(spark, sf_dir).select((F.regexp_extract("brand", "[0-9]+", 0).cast("int") - 1).alias("k"), "trend_class")
    coarse = cells.join(of, (5 * F.col("row") + F.col("col")) % 25 == F.col("k")).select("row", "col", "trend_class")
    rows = cells.agg(F.max("row")).first()[0] or 0
    return L.overlay_code(fine, coarse, {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": -1.0}, {"x0": 0.0, "sx": 8.0, "y0": 0.0, "sy": -8.0, "width": 5, "height": rows + 1})


@query(f"""WITH {PART}, c AS (SELECT row_, col_, col_ + 0.5 AS x, row_ + 0.5 AS y, {HEIGHT} AS h FROM px)
SELECT row_ AS "row", col_ AS col, CAST(r_regionkey AS INTEGER) AS region_id FROM c JOIN region ON
CASE WHEN r_regionkey % 2 = 0 THEN x > 8 * r_regionkey AND x < 8 * r_regionkey + 8 AND y > 0 AND y < 0.75 * h
     ELSE x > 8 * r_regionkey AND y > 0 AND (x - 8 * r_regionkey) / 8 + y / h < 1 END""")
def clip_to_regions(spark, sf_dir):
    k, none, h = F.col("r_regionkey") * 8.0, F.lit(0.0), F.col("h")
    square = F.array(corner(k, none), corner(k + 8, none), corner(k + 8, 0.75 * h), corner(k, 0.75 * h))
    triangle = F.array(corner(k, none), corner(k + 8, none), corner(k, h))
    return clipped(spark, sf_dir, F.array(F.when(F.col("r_regionkey") % 2 == 0, square).otherwise(triangle)))


@query(f"""WITH {PART}, c AS (SELECT row_, col_, col_ + 0.5 AS x, row_ + 0.5 AS y, {HEIGHT} AS h FROM px)
SELECT row_ AS "row", col_ AS col, CAST(r_regionkey AS INTEGER) AS region_id FROM c JOIN region ON
y < h AND x >= r_regionkey AND x < 40 - r_regionkey AND (x >= 30 OR y < 0.25 * h OR y >= 0.5 * h)
AND NOT (x >= 5 AND x < 20 AND y >= 0.0625 * h AND y < 0.1875 * h) OR y >= 0.625 * h AND y < 0.875 * h AND x >= 40 - r_regionkey AND x < 41""")
def clip_with_holes(spark, sf_dir):
    """Regions with a bay from the left, a hole and an exclave; a centre on an upper or a left edge is inside, one on the others not."""
    k, w, none, h = F.col("r_regionkey") * 1.0, 40.0 - F.col("r_regionkey"), F.lit(0.0), F.col("h")
    at = lambda x: F.lit(float(x))
    outer = F.array(corner(k, none), corner(w, none), corner(w, h), corner(k, h), corner(k, 0.5 * h), corner(at(30), 0.5 * h), corner(at(30), 0.25 * h), corner(k, 0.25 * h))
    box = lambda x1, x2, y1, y2: F.array(corner(x1, y1), corner(x1, y2), corner(x2, y2), corner(x2, y1))
    return clipped(spark, sf_dir, F.array(outer, box(at(5), at(20), 0.0625 * h, 0.1875 * h), box(w, at(41), 0.625 * h, 0.875 * h)))


def corner(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def clipped(spark: SparkSession, sf_dir: str, rings: Column) -> DataFrame:
    """row, col, region_id of the part raster's pixels in the regions; rings may use its height h."""
    px = part_raster(spark, sf_dir).select("row", "col")
    regions = table(spark, sf_dir, "region").withColumn("h", px.agg(F.max("row") + 1.0).scalar())
    regions = regions.select(F.col("r_regionkey").cast("int").alias("region_id"), rings.cast(RINGS).alias("rings"))
    return clip(px, regions, {"x0": 0.0, "sx": 1.0, "y0": 0.0, "sy": 1.0}).select("row", "col", "region_id")
