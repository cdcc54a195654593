"""Points and boxes that meet, by a quadtree over counted density."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Levels of the tree; its finest cells are 1 / 2 ** DEPTH of the boxes' common box wide.
DEPTH = 12
#: A cell is cut in four while it holds more than this, and more than so small a share of all points and boxes. The share
#: bounds the number of leaves: 4 * DEPTH * LEAVES at most.
LEAST, LEAVES = 256, 1024
#: A leaf is dealt out in parts of so much, so that a task's work doesn't grow with the table.
HEAVY = 1 << 20


def _spread(c: Column) -> Column:
    """The bits of a number of up to 16 bits, with a gap after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_cell(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """The number of the finest cell at a point of the box (minx, maxx, miny, maxy), in Z-order."""
    minx, maxx, miny, maxy = box
    side = 1 << DEPTH
    at = lambda v, lo, hi: F.least(F.lit(side - 1), F.floor((v - lo) / ((hi - lo) or 1.0) * side)).cast("long")
    return _spread(at(x, minx, maxx)).bitwiseOR(F.shiftleft(_spread(at(y, miny, maxy)), 1)).cast("long")


def quadtree(cells: DataFrame, least: int = LEAST) -> pd.DataFrame:
    """first, level, n of the leaves, in the order of the finest cells at which they begin.

    cells: (z, n), how much lies in each finest cell. A node is a leaf if it holds no more than the limit, or is a finest
    cell, and its parent holds more. All nodes are counted in one aggregation; only leaves reach the driver, LEAVES bounds
    how many.
    """
    nodes = cells.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), "z", "n")
    node = F.call_function("shiftright", F.col("z"), 2 * (DEPTH - F.col("level")))
    counted = nodes.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(least, -(-total // LEAVES))
    parent = counted.where(F.col("n") > limit).select((F.col("level") + 1).alias("level"), F.col("node").alias("parent"))
    small = counted.where((F.col("n") <= limit) | (F.col("level") == DEPTH)).withColumn("parent", F.shiftright("node", 2))
    leaves = small.join(parent, ["level", "parent"], "left_semi").unionByName(small.where("level = 0"))
    out = leaves.select(F.call_function("shiftleft", F.col("node"), 2 * (DEPTH - F.col("level"))).alias("first"), "level", "n").toPandas()
    out["parts"] = np.maximum(1, -(-out["n"] // min(limit, HEAVY))).astype(int)
    return out.sort_values("first", ignore_index=True)


def _unspread(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.int64) & 0x55555555
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        z = (z | z >> shift) & mask
    return z


def leaf_boxes(leaves: pd.DataFrame) -> np.ndarray:
    """First and last finest column and row of each leaf."""
    width = 1 << (DEPTH - leaves["level"].to_numpy(np.int64))
    x, y = _unspread(leaves["first"].to_numpy()), _unspread(leaves["first"].to_numpy(np.int64) >> 1)
    return np.stack([x, x + width - 1, y, y + width - 1])


def points_in_boxes(points: DataFrame, boxes: DataFrame, least: int = LEAST) -> DataFrame:
    """Columns of points (with x, y) and of boxes (with minx, maxx, miny, maxy) for every point in a box, edges included.

    Points and the centres of boxes are counted in fine cells, and a quadtree splits where they are dense, so each side goes
    to leaves of about equal weight, a box to all that it touches. A leaf that is still too heavy, as where a third of all
    points are in one place or where the table is large, is dealt out: its points by their hash, its boxes to each part. The exact test follows.
    Points without x or y, and boxes without an edge, meet nothing. Names of points that boxes have too are an error.
    """
    clash = {c.lower() for c in points.columns} & {c.lower() for c in boxes.columns}
    if clash:
        raise ValueError(f"points and boxes both have {sorted(clash)}")
    edges = ("minx", "maxx", "miny", "maxy")
    boxes = boxes.where(F.expr(" AND ".join(f"{e} IS NOT NULL AND NOT isnan({e})" for e in edges)))
    facts = boxes.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()
    if any(v is None for v in facts):
        return points.sparkSession.createDataFrame([], StructType([*points.schema.fields, *boxes.schema.fields]))
    box = tuple(map(float, facts))
    near = points.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    centres = boxes.select(((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    z = z_cell(F.col("x"), F.col("y"), box).alias("z")
    # Counts of finest cells, bounded by their number, are asked twice.
    cells = near.select(z).unionByName(centres.select(z)).groupBy("z").agg(F.count("*").alias("n")).persist()
    leaves = quadtree(cells, least)
    cells.unpersist()
    shared = points.sparkSession.sparkContext.broadcast((leaves["first"].to_numpy(np.int64), leaves["parts"].to_numpy(np.int32), leaf_boxes(leaves)))

    @F.pandas_udf("struct<leaf: int, parts: int>")
    def leaf_of(cell: pd.Series) -> pd.DataFrame:
        first, parts, _ = shared.value
        leaf = np.searchsorted(first, cell.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"leaf": leaf.astype(np.int32), "parts": parts[leaf]})

    @F.pandas_udf("array<struct<leaf: int, part: int>>")
    def cover(minx: pd.Series, maxx: pd.Series, miny: pd.Series, maxy: pd.Series) -> pd.Series:
        _, parts, (x1, x2, y1, y2) = shared.value
        out, side = [], 1 << DEPTH
        at = lambda v, lo, hi: np.minimum(side - 1, np.floor((v.to_numpy() - lo) / ((hi - lo) or 1.0) * side)).astype(np.int64)
        for a, b, c, d in zip(at(minx, *box[:2]), at(maxx, *box[:2]), at(miny, *box[2:]), at(maxy, *box[2:]), strict=True):
            hit = np.flatnonzero((x1 <= b) & (x2 >= a) & (y1 <= d) & (y2 >= c))
            out.append([{"leaf": int(i), "part": k} for i in hit for k in range(parts[i])])
        return pd.Series(out)

    spread = boxes.withColumn("_at", F.explode(cover(*edges))).withColumns({"_leaf": F.col("_at.leaf"), "_part": F.col("_at.part")}).drop("_at")
    own = near.withColumn("_at", leaf_of(z)).withColumns({"_leaf": F.col("_at.leaf"), "_part": F.pmod(F.xxhash64(*points.columns), F.col("_at.parts")).cast("int")}).drop("_at")
    x, y = F.col("x"), F.col("y")
    hit = own.join(spread, ["_leaf", "_part"]).where((x >= F.col("minx")) & (x <= F.col("maxx")) & (y >= F.col("miny")) & (y <= F.col("maxy")))
    return hit.drop("_leaf", "_part")
