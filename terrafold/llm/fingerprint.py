"""Operator 2: document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A sketch hashes each paragraph's digest into three cells that hold a count, a sum of digests and a sum of check values.
Subtracting two sketches cancels what both texts have; peeling cells with one digest left recovers the paragraphs in
which they differ, and where that fails, both are sketched anew with more cells.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions

#: A word whose hash has this many low zero bits ends a piece, so that long paragraphs are compared piece by piece.
ENDING_BITS = 2
HASHES = 3
#: Cells of the sketch that a fingerprint shows, and how many times more each further try has.
CELLS, MORE = 24, 5
_LOW, _LINE = np.uint64((1 << ENDING_BITS) - 1), np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def digests(texts: list[str]) -> list[np.ndarray]:
    """Of each text the digests of its paragraphs: lines in pieces of about four words that end where their own words say so.

    Repeated paragraphs differ by how often they came before, so the digests are a set that stands for a multiset.
    """
    if not texts:
        return []
    split = [t.encode().replace(b"\n", b" \n ").split(b" ") for t in texts]
    n = np.array([len(x) for x in split])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    end = ((h & _LOW) == 0) | (h == _LINE)
    end[np.cumsum(n) - 1] = True
    starts = np.flatnonzero(np.append(True, end[:-1]))
    owner = owner[starts]
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    with np.errstate(over="ignore"):
        keys = np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
        times = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        keys = mixed(keys + times.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.split(keys, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def cells_of(keys: np.ndarray, owner: np.ndarray, start: np.ndarray, per_hash: np.ndarray) -> list[np.ndarray]:
    """For each hash function the cell of each key; each function has its own third of the owner's cells."""
    with np.errstate(over="ignore"):
        return [start[owner] + i * per_hash[owner] + (mixed(keys + np.uint64(i + 1) * np.uint64(0xA0761D6478BD642F)) % per_hash[owner].astype(np.uint64)).astype(np.int64) for i in range(HASHES)]


def check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


class Sketches:
    """Sketches of many sets side by side, each with its own number of cells."""

    def __init__(self, per_hash: np.ndarray):
        self.per_hash = per_hash.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(HASHES * self.per_hash)])
        n = int(self.start[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Add the keys, or subtract those whose sign is -1; sums are modulo 2**64."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        with np.errstate(over="ignore"):
            signed, checks = keys * sign.astype(np.uint64), check(keys) * sign.astype(np.uint64)
        for cell in cells_of(keys, owner, self.start, self.per_hash):
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, signed)
            np.add.at(self.checks, cell, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recover keys from cells with one left: the owners that ended empty, and by owner how many keys were recovered
        with either sign. The sketches are used up."""
        owner_of = np.repeat(np.arange(len(self.per_hash)), HASHES * self.per_hash)
        plus, minus = np.zeros(len(self.per_hash), np.int64), np.zeros(len(self.per_hash), np.int64)
        look = np.flatnonzero(self.count)
        while len(look):
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            with np.errstate(over="ignore"):
                keys = self.keys[one] * sign.astype(np.uint64)
                good = check(keys) == self.checks[one] * sign.astype(np.uint64)
            keys, sign, owner = keys[good], sign[good], owner_of[one[good]]
            if not len(keys):
                break
            first = distinct(keys, owner)
            keys, sign, owner = keys[first], sign[first], owner[first]
            plus += np.bincount(owner[sign > 0], minlength=len(plus))
            minus += np.bincount(owner[sign < 0], minlength=len(minus))
            self.add(keys, owner, -sign)
            look = np.concatenate(cells_of(keys, owner, self.start, self.per_hash))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return np.bincount(owner_of[left], minlength=len(plus)) == 0, plus, minus

    def less(self, other: Sketches) -> Sketches:
        """These sketches minus those of equal sizes."""
        out = Sketches(self.per_hash)
        with np.errstate(over="ignore"):
            out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def text(self, i: int) -> str:
        """One sketch as text: its cells' counts, digests and check values."""
        part = slice(self.start[i], self.start[i + 1])
        return base64.b64encode(self.count[part].astype("<i4").tobytes() + self.keys[part].astype("<u8").tobytes() + (self.checks[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()).decode()


def distinct(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The places of one of each owner's equal keys."""
    order = np.lexsort((keys, owner))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    return order[new]


def sketches(sets: list[np.ndarray], per_hash: int = CELLS // HASHES) -> Sketches:
    s = Sketches(np.full(len(sets), per_hash))
    s.add(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    return s


def fingerprints(sets: list[np.ndarray], made: Sketches | None = None) -> list[str]:
    """A sketch of CELLS cells of each set, as text after the number of its paragraphs."""
    made = made or sketches(sets)
    return [f"{len(x)}:{made.text(i)}" for i, x in enumerate(sets)]


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Sketches | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sets twice the shared paragraphs by the sum of both, and the cells that it took.

    first: the difference of their fingerprints. Pairs whose difference can't be peeled are sketched again with more
    cells, until it can.
    """
    na, nb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    differ, cells = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    todo, per_hash = np.arange(len(a)), CELLS // HASHES
    s = first or sketches(a).less(sketches(b))
    while len(todo):
        done, plus, minus = s.peel()
        ended = todo[done]
        differ[ended], cells[ended] = (plus + minus)[done], HASHES * per_hash
        todo, per_hash = todo[~done], per_hash * MORE
        s = Sketches(np.full(len(todo), per_hash))
        for sets, n, sign in ((a, na, 1), (b, nb, -1)):
            s.add(np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in todo]]), np.repeat(np.arange(len(todo)), n[todo]), sign)
    total = na + nb
    return np.where(total > 0, (total - differ) / np.maximum(total, 1), 1.0), cells


def next_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, place, doc_id, text): docs dealt by ranges of descending doc_id, null last, and of the hashes of texts; each part
    ends with a row of place 1, the first of the next part that has rows (after the last: the first of all). One shuffle
    of the texts. The ranges come from a shuffle of ids and hashes; a row a range reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = (F.col("doc_id").isNull().cast("int"), -F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(0)), F.col("h"))
    keys = docs.select(*[c.alias(n) for n, c in zip("abc", order, strict=True)]).repartitionByRange(partitions(spark), "a", "b", "c")
    heads = sorted(tuple(r["head"]) for r in keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("a", "b", "c")).alias("head")).collect())
    shared = spark.sparkContext.broadcast([(a, int(b), c) for a, b, c in heads])

    @F.pandas_udf("array<struct<part: int, place: int>>")
    def dealt(own: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        heads = shared.value
        out = []
        for x, missing, c in zip(own.tolist(), null.tolist(), h.tolist(), strict=True):
            key = (1, 0, c) if missing else (0, -x, c)
            p = bisect.bisect_right(heads, key) - 1
            out.append([{"part": p, "place": 0}] + ([{"part": (p - 1) % len(heads), "place": 1}] if heads[p] == key else []))
        return pd.Series(out)

    at = dealt(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.col("h"))
    rows = docs.select("doc_id", "text", "h", F.explode(at).alias("at")).select("at.part", "at.place", "doc_id", "h", "text")
    return rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "place", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")


def edited(text: str, after: str) -> str:
    """text whose last half of code points is replaced by as many of the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells for every row.

    The next document comes in descending order of doc_id, then ascending of the texts' hashes; null doc_ids are last and a
    null text is empty. The sketch that is shown is small: of two that differ in more than about a dozen pieces the
    difference is peeled from larger sketches of both sets, whose cells are counted in `cells`. A single row is its own next. Equal texts have equal fingerprints; two texts without difference have
    likeness 1. Extra columns are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for part, place, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if last is not None and last[0] == part:
                    held.append((last[1], last[2], text))
                    size += len(text)
                last = (part, doc_id, text) if not place else None
                if size > 1 << 21:
                    yield made(held)
                    held, size = [], 0
        yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        texts, after = [h[1] for h in held], [h[2] for h in held]
        new = [edited(t, a) for t, a in zip(texts, after, strict=True)]
        own, own_new = digests(texts), digests(new)
        apart = [i for i in range(len(held)) if i + 1 == len(held) or after[i] is not texts[i + 1]]
        own_after = own[1:] + own[:1]
        for i, x in zip(apart, digests([after[i] for i in apart]), strict=True):
            own_after[i] = x
        shown, shown_new = sketches(own), sketches(own_new)
        near, cells = likeness(own, own_new, shown.less(shown_new))
        near_next, _ = likeness(own, own_after)
        return pa.record_batch({
            "doc_id": pa.array([h[0] for h in held], pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            "fingerprint": pa.array(fingerprints(own, shown), pa.string()), "edited_fingerprint": pa.array(fingerprints(own_new, shown_new), pa.string()),
            "near_edited": pa.array(near, pa.float64()), "near_next": pa.array(near_next, pa.float64()), "cells": pa.array(cells, pa.int64()),
        })

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells long"
    return next_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null text is empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(digests([t or "" for t in texts])), dtype=object)

    return docs.select("doc_id", run("text").alias("fingerprint"))

