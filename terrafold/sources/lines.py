"""Lines of text files with their places, without any file as one value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "name string, path string, start long, number long, before long, line binary"


def file_lines(spark: SparkSession, path: str, name: Column | None = None, glob: str | None = None, weigh: Callable[[bytes], int] | None = None) -> DataFrame:
    """name, path, start, number, before, line of all lines below a path.

    A file is read in parts, each a task's or a part of one, so a file of any size is spread and never held. start: where in
    its file a line's part begins; number: its place in its part, from 0, so in its file where start is 0. before: the sum of
    weigh over the lines before it in its part (0 without one). name: an expression on `_metadata`; the file's path by
    default. Spark opens the files, so they may be in any store that it reads.
    """
    rows = spark.read.option("recursiveFileLookup", True)
    rows = (rows.option("pathGlobFilter", glob) if glob else rows).text(path)
    meta = F.col("_metadata")
    rows = rows.select((meta["file_path"] if name is None else name).cast("string"), meta["file_path"], meta["file_block_start"], F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = None, 0, 0
        for batch in batches:
            paths, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            of = paths.indices.to_numpy()
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(starts)]
            weight = np.array([weigh(v) for v in batch.column(3).to_pylist()], np.int64) if weigh else np.zeros(len(starts), np.int64)
            numbers, sums = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                own = paths.dictionary[int(of[a])].as_py(), int(starts[a])
                if own != part:
                    part, number, before = own, 0, 0
                numbers[a:b] = number + np.arange(b - a)
                total = np.cumsum(weight[a:b])
                sums[a:b] = before + total - weight[a:b]
                number, before = number + b - a, before + int(total[-1])
            yield pa.record_batch([*batch.columns[:3], pa.array(numbers), pa.array(sums), batch.column(3)], names=["name", "path", "start", "number", "before", "line"])

    return rows.toDF("name", "path", "start", "line").mapInArrow(run, LINES)
