"""Land-cover classes over years, and the overlay with trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inside, pixel_center, raster_extent, world_to_pixel


def remap_classes(px: DataFrame, groups: DataFrame) -> DataFrame:
    """Pixels of the classes that have a group, with it; a small lookup is broadcast by its size."""
    return px.join(groups, "class_id")


#: Groups of classes are a legend, not data; more than so many are an error.
MOST_GROUPS = 1000


#: Years of a word of the mask.
WORD = 64


def class_stability(px: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("row", "col"), min_years: int = 20, include_zero: bool = False) -> DataFrame:
    """n_years, longest_run, stable, not_stable by pixel and group: the different years in the group, the most of them in a
    row, and whether there are enough. Repeated rows of a pixel and year, and classes of a group twice, change nothing; rows
    without a year don't count. Pixels without a year in a group are left out unless include_zero.

    A pixel's years are bits of a mask, a word for each 64 years, so rows are combined before they are shuffled.
    """
    year = F.col("year").cast("int")
    word = F.floor(year / WORD).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), year - WORD * word)
    masks = remap_classes(px, groups.select("class_id", "group").distinct()).where(year.isNotNull()).groupBy(*keys, "group", word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))
    n = masks.groupBy(*keys, "group").agg(F.sum(F.bit_count("_mask")).alias("n_years"), F.sort_array(F.collect_list(F.struct("_word", "_mask"))).alias("_words"))
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    of_word = lambda w: F.transform(F.filter(bits, lambda b: F.call_function("shiftright", w["_mask"], b).bitwiseAND(F.lit(1)) == 1), lambda b: WORD * w["_word"] + b)
    years, none = F.flatten(F.transform("_words", of_word)), F.lit(None).cast("int")
    start = F.struct(none.alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, y):
        run = F.when(y == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(y.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    n = n.select(*keys, "group", "n_years", F.aggregate(years, start, step, lambda s: s["best"]).alias("longest_run"))
    if include_zero:
        names = [r["group"] for r in groups.select("group").distinct().limit(MOST_GROUPS + 1).collect()]
        if len(names) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        grid = px.select(*keys).distinct().withColumn("group", F.explode(F.array(*[F.lit(g) for g in names])))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_years", "longest_run")}
        n = grid.join(n, [*keys, "group"], "left").withColumns(zero)
    return n.withColumn("stable", F.when(F.col("n_years") >= min_years, 1).otherwise(0)).withColumn("not_stable", 1 - F.col("stable"))


#: Fine pixels that meet one block of coarse cells, about, and the most cells along its side.
TOGETHER, MOST_CELLS = 1 << 12, 64


def block_side(fine: dict[str, float], coarse: dict[str, float]) -> int:
    """Cells along the side of a block, so that about TOGETHER fine pixels lie on it."""
    pixels = max(1.0, abs(coarse["sx"] * coarse["sy"] / (fine["sx"] * fine["sy"])))
    return int(min(MOST_CELLS, max(1, (TOGETHER / pixels) ** 0.5)))


def dense_blocks(cells: DataFrame, value: str, side: int) -> DataFrame:
    """block_row, block_col, cells: side * side values of a block in row order, null where there is none; of a repeated cell
    the largest value."""
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    place = (F.col("row") - side * F.col("block_row")) * side + F.col("col") - side * F.col("block_col")
    keyed = cells.select("row", "col", at("row").alias("block_row"), at("col").alias("block_col"), F.col(value).alias("value"))
    by = keyed.groupBy("block_row", "block_col", place.cast("int").alias("place")).agg(F.max("value").alias("value"))
    packed = by.groupBy("block_row", "block_col").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    return packed.select("block_row", "block_col", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.element_at("m", i)).alias("cells"))


def overlay_code(map_px: DataFrame, trend: DataFrame, fine: dict[str, float], coarse: dict[str, float]) -> DataFrame:
    """row, col, code of the map: 10 * class + trend class of the coarse cell under the pixel's centre; 0 for class 0, for no
    class, outside, on the edge and where the coarse cell has no data.

    Coarse cells are dense blocks by block number: the pixels on a block meet one row of the coarse side, and its value is
    read from the array. Pixels that need no cell take no part in the join, so nothing is dealt by null keys.
    """
    x, y = pixel_center(F.col("row"), F.col("col"), *(F.lit(fine[k]) for k in ("x0", "sx", "y0", "sy")))
    ext = raster_extent(*(F.lit(coarse[k]) for k in ("x0", "sx", "y0", "sy", "width", "height")))
    r, c = world_to_pixel(x, y, *(F.lit(float(coarse.get(k, 0))) for k in ("x0", "sx", "rx", "y0", "ry", "sy")))
    used = F.coalesce((F.col("class_id") != 0) & inside(x, y, *ext, inclusive=False), F.lit(False))
    side = block_side(fine, coarse)
    blocks = dense_blocks(trend.select("row", "col", "trend_class"), "trend_class", side)
    px = map_px.select("row", "col", "class_id").where(used).withColumns({"_r": r, "_c": c})
    px = px.withColumns({"block_row": F.floor(F.col("_r") / side).cast("int"), "block_col": F.floor(F.col("_c") / side).cast("int")})
    place = (F.col("_r") - side * F.col("block_row")) * side + F.col("_c") - side * F.col("block_col")
    under = F.coalesce(F.get("cells", place.cast("int")), F.lit(0))
    code = F.when(under != 0, 10 * F.col("class_id") + under).otherwise(0)
    met = px.join(blocks, ["block_row", "block_col"], "left").select("row", "col", code.cast("int").alias("code"))
    return met.unionByName(map_px.where(~used).select("row", "col", F.lit(0).alias("code")))
