"""Operator 12: importance resampling towards a target distribution.

Texts are read in blocks. A block numbers its own words, so that each of them leaves it once, and keeps its documents as
counts of these numbers. The words of all blocks meet once, sorted: each distinct word gets an integer id. A run of words
is the tuple of their ids; each distinct tuple is written out and hashed once (a run of one word is the word), and its
bucket goes back to the blocks that hold it, where counts and gains meet.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleared, matches, ranked, release, small_batches, tidied, written

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The longest run of words that is a feature, and the number of buckets.
LONGEST_RUN, BUCKETS = 1, 10_000
#: Documents of fewer words are never drawn; of the others so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: A block has so many bytes of text (64 more for each document), or one document.
BLOCK = 1 << 24
_find, _gap = re.compile(WORD).findall, re.compile(BETWEEN).search

BLOCKS = "block long, doc_id long, side int, n_words long, n_features long, counts binary, local int, word string, run array<int>, n long"


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers and how often each occurs, as differences and counts, compressed byte by byte of their width."""
    values, n = np.unique(x, return_counts=True)
    both = np.concatenate([np.diff(values, prepend=0), n]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


class Block:
    """The documents of a block as numbers of its words."""

    def __init__(self, number: int, side: int):
        self.number, self.side, self.size = number, side, 0
        self.words, self.ids, self.texts = Numbers(), [], []

    def add(self, doc_id: int | None, text: bytes) -> None:
        number = self.words.__getitem__
        parts = [np.fromiter(map(number, found), np.int32, len(found)) for found in matches(text, _find, _gap)]
        self.ids.append(doc_id)
        self.texts.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        self.size += len(text) + 64

    def rows(self, longest: int) -> Iterator[pa.RecordBatch]:
        """Each word with its number and count; each longer run, numbered after the words; each document of the first side."""
        n_words = np.array([len(t) for t in self.texts])
        flat = np.concatenate(self.texts)
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        known = len(self.words)
        yield self.batch(known, local=pa.array(np.arange(known, dtype=np.int32)), word=words, n=pa.array(np.bincount(flat, minlength=known)))
        own, n = self.texts, n_words
        if longest > 1:
            own, n = yield from self.runs(flat, n_words, longest)
        if not self.side:
            counts = pa.array([packed(x) for x in own], pa.binary())
            yield self.batch(len(own), doc_id=pa.array(self.ids, pa.int64()), n_words=pa.array(n_words), n_features=pa.array(n), counts=counts)

    def runs(self, flat: np.ndarray, n_words: np.ndarray, longest: int) -> Generator[pa.RecordBatch, None, tuple[list[np.ndarray], np.ndarray]]:
        """Each run of 2 to longest words, numbered after the words; returns the features of each document and how many."""
        known, flat, owner = len(self.words), flat.astype(np.int64), np.repeat(np.arange(len(self.texts)), n_words)
        features, owners, tuples, prefix = [flat], [owner], np.arange(known)[:, None], flat
        for size in range(2, longest + 1):
            m = max(0, len(flat) - size + 1)
            whole = np.flatnonzero(owner[:m] == owner[size - 1 :][:m])
            keys, at, n = np.unique(prefix[whole] << 32 | flat[whole + size - 1], return_inverse=True, return_counts=True)
            tuples = np.hstack([tuples[keys >> 32], (keys & 0xFFFFFFFF)[:, None]])
            if len(keys):
                run = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * size, pa.array(tuples.ravel().astype(np.int32)))
                yield self.batch(len(keys), local=pa.array(np.arange(known, known + len(keys), dtype=np.int32)), run=run, n=pa.array(n))
            prefix = np.zeros(len(flat), np.int64)
            prefix[whole] = at
            features.append(known + at)
            owners.append(owner[whole])
            known += len(keys)
        feature, owner = np.concatenate(features), np.concatenate(owners)
        n = np.bincount(owner, minlength=len(self.texts))
        return np.split(feature[np.argsort(owner, kind="stable")], np.cumsum(n)[:-1]), n

    def batch(self, k: int, **columns: pa.Array) -> pa.RecordBatch:
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "counts": pa.binary(), "local": pa.int32(), "word": pa.string(), "run": pa.list_(pa.int32()), "n": pa.int64()}
        fixed = {"block": pa.array(np.full(k, self.number, np.int64)), "side": pa.array(np.full(k, self.side, np.int32))}
        made = fixed | {c: columns[c].cast(t) if c in columns else pa.nulls(k, t) for c, t in types.items()}
        return pa.record_batch({c.split()[0]: made[c.split()[0]] for c in BLOCKS.split(", ")})


def blocks(docs: DataFrame, target: DataFrame, longest: int, size: int = BLOCK) -> DataFrame:
    """The blocks of both tables as rows of BLOCKS: words, longer runs, and the documents of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        own, n = None, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for side, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if own and (own.side != side or own.size >= size):
                    yield from own.rows(longest)
                    own = None
                if own is None:
                    own, n = Block(first + n, side), n + 1
                own.add(doc_id, (text.as_py() or b"").lower())
        if own:
            yield from own.rows(longest)

    small_batches(docs.sparkSession)
    of = lambda side, doc_id, df: df.select(F.lit(side).alias("side"), doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of(0, F.col("doc_id"), docs).union(of(1, F.lit(None), target)).mapInArrow(tidied(run), BLOCKS)


def numbered(words: DataFrame, buckets: int) -> DataFrame:
    """block, local, side, n of each block's words with the id and the bucket of the word, and the word itself in the first
    row that has it. Equal words come together, one row a block; each distinct one is numbered and hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, seen, bucket = TaskContext.get().partitionId() << 40, None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word")
            new = np.ones(len(word), bool)
            new[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            new[0] = word[0].as_py() != last
            distinct = word.filter(pa.array(new)).cast(pa.binary()).to_pylist()
            hashed = np.array([bucket, *[zlib.crc32(w) % buckets for w in distinct]], np.int32)
            at = np.cumsum(new)
            shown = pc.if_else(pa.array(new), word, pa.scalar(None, pa.string()))
            yield pa.record_batch(
                {c: batch.column(c) for c in ("block", "local", "side", "n")} | {"id": pa.array(first + seen + at), "bucket": pa.array(hashed[at]), "word": shown}
            )
            seen, bucket, last = seen + int(at[-1]), int(hashed[-1]), word[len(word) - 1].as_py()

    rows = words.repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(tidied(run), "block long, local int, side int, n long, id long, bucket int, word string")


def longer_runs(runs: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """block, local, side, n, bucket of the runs of several words: as tuples of word ids, each distinct one hashed once."""

    def ids(run: pd.DataFrame, word: pd.DataFrame) -> pd.DataFrame:
        of = np.zeros(int(word["local"].max()) + 1 if len(word) else 0, np.int64)
        of[word["local"].to_numpy()] = word["id"].to_numpy()
        return run[["block", "local", "side", "n"]].assign(ids=[of[np.asarray(r)] for r in run["run"]])

    grouped = runs.groupBy("block").cogroup(words.select("block", "local", "id").groupBy("block"))
    rows = written(grouped.applyInPandas(ids, "block long, local int, side int, n long, ids array<long>"), "runs")
    each = rows.select("ids").distinct().select("ids", F.posexplode("ids").alias("pos", "id"))
    spelled = each.join(words.where("word IS NOT NULL").select("id", "word"), "id").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
    text = F.array_join(F.col("words.word"), " ")
    return rows.join(spelled.select("ids", (F.crc32(text.cast("binary")) % buckets).cast("int").alias("bucket")), "ids").select("block", "local", "side", "n", "bucket")


def gains(features: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket that occurs; at most `buckets` rows."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).cast("double")
    found = features.groupBy("bucket").agg(side(0).alias("s"), side(1).alias("t"))
    every = lambda c: F.sum(c).over(Window.partitionBy())
    ratio = (F.col("t") + 1) * (every("s") + buckets) / ((F.col("s") + 1) * (every("t") + buckets))
    return found.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and doc_id; a null doc_id counts as ''."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where it isn't drawn.

    Features are all runs of 1 to longest words, repeats counted. A null or empty text has none, and weight 0. Equal scores
    are ordered by doc_id (null first), then by n_features and weight; repeated rows take ranks one after another. An empty target has no
    features; an empty table of documents gives an empty one. Extra columns are left out. Texts are read whole, in parts.
    """
    made: list[str] = []
    rows = written(blocks(docs, target, longest), "blocks", made)
    words = written(numbered(rows.where("word IS NOT NULL").select("block", "local", "side", "n", "word"), buckets), "numbered", made)
    features = words.select("block", "local", "side", "n", "bucket")
    if longest > 1:
        features = features.unionByName(longer_runs(rows.where("run IS NOT NULL").select("block", "local", "side", "n", "run"), words, buckets))
        features = written(features, "features", made)
    of_bucket = written(gains(features, buckets), "gains", made)
    back = features.where("side = 0").join(F.broadcast(of_bucket), "bucket").select("block", "local", F.col("gain").cast("int").alias("gain"))

    def weigh(doc: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        gain = np.zeros(int(own["local"].max()) + 1 if len(own) else 0, np.int64)
        gain[own["local"].to_numpy()] = own["gain"].to_numpy()
        weight = []
        for n, data in zip(doc["n_features"], doc["counts"], strict=True):
            at, k = unpacked(data)
            weight.append(int((gain[at] * k).sum()) // int(n) if n else 0)
        release()
        return doc[["doc_id", "n_words", "n_features"]].assign(weight=np.array(weight, np.int64))

    held = rows.where("counts IS NOT NULL").select("block", "doc_id", "n_words", "n_features", "counts")
    weighed = held.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    cleared(docs.sparkSession, made)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
