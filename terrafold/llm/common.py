"""What the operators of this subpackage share: the shared folder, fresh names, words and hashed words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path, removed, shared_dir

#: One word of a text, as the contracts of the queries define it.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut; the rows go to the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; its path is noted in made."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, made: list[str]) -> None:
    """Remove what written noted; nothing may read it any more."""
    for path in made:
        removed(spark, path)
    made.clear()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, so that added columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of whole texts that go to a worker at once, where the session has Spark's default, ten times as many.
ROWS_AT_ONCE, SPARK_ROWS = "1000", "10000"


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to workers in small batches, unless the session says how many rows a batch has: Spark's default is
    made for rows of numbers, and both sides hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARK_ROWS:
        spark.conf.set(name, ROWS_AT_ONCE)


def release() -> None:
    """Give back what Arrow holds for reuse: a worker waits for other tasks, and for other stages, with what it has."""
    pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, followed by release."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def hashed(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SPACES = b" \t\n\x0b\x0c\r"
_WITHIN = ~np.isin(np.arange(256), list(_SPACES))
_ENDS = re.compile(rb"[\x20\x09-\x0D]").search
#: Words of up to so many bytes have a value for each byte at each place; longer ones are hashed whole.
_PLACES = 64
_VALUES = mixed(np.arange(256 * _PLACES, dtype=np.uint64) + np.uint64(1))
#: Texts are read in parts of so many bytes, so that what is held beside a text is small.
_PART = 1 << 18


def _part_hashes(part: bytes) -> np.ndarray:
    data = np.frombuffer(part, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = np.take(_WITHIN, data)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    data = data[inside[1:-1]]
    if not len(data):
        return np.zeros(0, np.uint64)
    n = edge[1::2] - edge[::2]
    start = np.cumsum(n) - n
    place = np.arange(len(data)) - np.repeat(start, n)
    long = np.flatnonzero(n > _PLACES)
    out = np.add.reduceat(np.take(_VALUES, ((np.minimum(place, _PLACES - 1) if len(long) else place) << 8) | data), start)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(part[edge[2 * i] : edge[2 * i + 1]])
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text with A-Z lower-cased, in order; white space is ASCII alone, as the contract
    has it. A hash is the sum of values that bytes have at their places in the word."""
    data, out, at = (text or "").encode().lower(), [], 0
    while at < len(data):
        end = len(data)
        if end - at > _PART:
            end = max(data.rfind(bytes([x]), at, at + _PART) for x in _SPACES)
            if end <= at:
                # One word fills the part.
                found = _ENDS(data, at + 1)
                end = found.start() if found else len(data)
                word = data[at:end].strip(_SPACES)
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64) if len(word) > _PLACES else _part_hashes(word))
                at = end
                continue
        out.append(_part_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; plain sorting is several times faster here than numpy's unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words the whole sequence is one; without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[i : len(h) - size + 1 + i]
    return distinct(mixed(out))


def matches(text: bytes, find: Callable[[bytes], list[bytes]], gap: Callable[[bytes, int], re.Match | None], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """What find gives for a whole text, in parts of about so many bytes that end at a gap between matches; one part at least."""
    at = 0
    while len(text) - at > size:
        between = gap(text, at + size)
        if not between:
            break
        yield find(text[at : between.start()])
        at = between.start()
    yield find(text[at:] if at else text)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the given order, from 1. Rows are dealt by ranges and sorted there; the sizes of the
    ranges, one number each, give where a range begins. Rows that are equal in the order may span ranges."""
    tie = fresh(df, "tie")
    rows = written(df.withColumn(tie, F.monotonically_increasing_id()), "to-rank")
    rows = rows.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, tie).drop(tie)
    at, part, before = (fresh(df, c) for c in ("at", "part", "before"))
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(part).agg(F.count("*").alias(before))
    starts = sizes.withColumn(before, F.sum(before).over(Window.orderBy(part)) - F.col(before))
    out = rows.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return out.drop(at, part, before)
