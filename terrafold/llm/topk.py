"""Operator 9: exact top-k inner products by norm order, rotation and residual bounds.

Vectors are sorted by descending length and cut into chunks. The longest of all give each query a first k-th score;
queries are put into blocks by the least length that a vector then needs, so a chunk goes to those blocks alone that its
longest vector may serve, and meets them in descending order of length, until no query of the block can gain. In the
basis of the singular vectors of all vectors the first coordinates carry most of a product; what the others can add is
at most the product of the residual lengths (Cauchy-Schwarz). Only pairs whose bound reaches the query's k-th score so
far are computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions

#: Vectors in a chunk of candidates, queries in a block at most (about), candidates that are bounded at once.
CHUNK, QUERIES, STEP = 2048, 2048, 512
#: The longest vectors, which give the first k-th scores; and the classes of needed lengths. Both reach the driver.
SEEDS, CLASSES = 512, 64
#: Share of the coordinates in the first part of a product.
LEADING = 0.5
#: The share of pairs within their bounds from which on whole matrices are multiplied.
DENSE = 0.05
#: Bounds are raised by this share of the product of the two lengths, far more than rounding takes from them.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null for a vector that is null or holds a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of v v^T: each task sums its own rows, 16 tasks sum these sums, and 16 matrices reach the driver."""

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"part": pa.array([int(total.sum()) & 0xFFFF]), "sums": pa.array([total.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        yield one(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for sums in batch.column(1):
                total += np.frombuffer(sums.as_buffer(), np.float64).reshape(width, width)
        yield one(total)

    kinds = "part long, sums binary"
    sums = vectors.select("v").mapInArrow(run, kinds).repartition(16, "part").mapInArrow(again, kinds).collect()
    return np.sum([np.frombuffer(r["sums"], np.float64).reshape(width, width) for r in sums], axis=0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    n = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Best:
    """The k best (score, smaller id first) of each of some queries so far; rows that repeat are rows of their own."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def put(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(row)
        r = np.concatenate([row, np.repeat(rows, self.k)])
        s, i = np.concatenate([score, self.score[rows].ravel()]), np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((i, ~s, r))
        r, s, i = r[order], s[order], i[order]
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
        top = place < self.k
        self.score[r[top], place[top]], self.id[r[top], place[top]] = s[top], i[top]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


class Block:
    """The queries of one block in one task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, basis: np.ndarray, lead: int, k: int):
        self.ids, self.q, self.basis, self.lead = ids, q, basis, lead
        self.floor, self.lengths, self.best = floor.astype(np.float64), lengths(q), Best(len(ids), k)
        self.real = q.astype(np.float64)
        turned = self.real @ basis
        self.first, self.rest = turned[:, :lead], lengths(turned[:, lead:])

    def worst(self) -> np.ndarray:
        """What a score must reach to matter, by query."""
        return np.maximum(self.floor, self.best.score[:, -1].astype(np.float64))

    def search(self, ids: np.ndarray, v: np.ndarray) -> bool:
        """Look through vectors of descending length; false when no query can gain from shorter ones."""
        long, real = lengths(v), v.astype(np.float64)
        turned = real @ self.basis
        first, rest = turned[:, : self.lead], lengths(turned[:, self.lead :])
        # Doubles hold whole numbers below 2**53 exactly, and no partial sum exceeds the product of the lengths.
        exact = self.lengths.max(initial=0) * long.max(initial=0) < 2**52
        for at in range(0, len(ids), STEP):
            part, worst = slice(at, at + STEP), self.worst()
            live = np.flatnonzero(self.lengths * long[at] * (1 + SLACK) >= worst)
            if not len(live):
                return False
            both = np.outer(self.lengths[live], long[part])
            bound = self.first[live] @ first[part].T + np.outer(self.rest[live], rest[part]) + SLACK * both
            may = bound >= worst[live][:, None]
            if exact and may.mean() > DENSE:
                # Where most pairs pass the bound, whole rows of products are cheaper than picked ones.
                score = self.real[live] @ real[part].T
                row, col = np.nonzero(may & (score >= worst[live][:, None]))
                self.put(live[row], col + at, score[row, col].astype(np.int64), ids)
                continue
            row, col = np.nonzero(may)
            row, col = live[row], col + at
            a, b = (self.real, real) if exact else (self.q, v)
            for some in range(0, len(row), 1 << 16):
                r, c = row[some : some + (1 << 16)], col[some : some + (1 << 16)]
                score = np.einsum("ij,ij->i", a[r], b[c])
                good = score >= worst[r]
                self.put(r[good], c[good], score[good].astype(np.int64), ids)
        return True

    def put(self, row: np.ndarray, col: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        other = self.ids[row] != ids[col]
        if other.any():
            self.best.put(row[other], score[other], ids[col[other]])

    def found(self) -> pa.RecordBatch:
        have = self.best.score != NONE
        return pa.record_batch({"query_id": pa.array(np.repeat(self.ids, self.best.k)[have.ravel()]), "vec_id": pa.array(self.best.id[have]), "score": pa.array(self.best.score[have])})


FOUND = "query_id long, vec_id long, score long"
#: A chunk of queries (kind 0, with what their scores must reach) or of candidates (kind 1), and its longest length.
PACKED = "block int, salt int, kind int, longest double, ids binary, data binary, floor binary"


def _packed(block: int, salt: int, kind: int, ids: np.ndarray, v: np.ndarray, floor: np.ndarray | None = None) -> tuple:
    return block, salt, kind, float(lengths(v).max(initial=0)), ids.tobytes(), v.tobytes(), None if floor is None else floor.tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.record_batch({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of vectors (vec_id, embedding) for which `queries` holds the k highest
    whole-number inner products with all rows of another vec_id, ties to the smaller vec_id.

    Rows that repeat a vec_id are candidates each for itself, so they may fill several ranks; query rows that repeat one
    share its k ranks, and what several of them find counts as often. Vectors that are null or hold a null or non-finite
    component, and rows without a vec_id, take no part; shorter vectors count as filled with zeros. Fewer than k
    candidates give fewer rows; empty tables none; extra columns are left out. Products must stay below 2**63.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"), queries.alias("is_query")).where("vec_id is not null and v is not null")
    rows = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).withColumn("n", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    seen = rows.agg(F.max(F.size("v")).alias("width"), F.count_if("is_query").alias("queries")).first()
    width, n_queries = max(1, seen["width"] or 1), seen["queries"]
    basis = np.linalg.eigh(gram(rows, width))[1][:, ::-1].copy()
    lead = max(1, int(width * LEADING))
    seeds = rows.orderBy(F.desc("sq"), "vec_id", "n").limit(SEEDS).select("vec_id", "v").collect()
    seed_ids, seed_v = np.array([r["vec_id"] for r in seeds], np.int64), np.array([r["v"] + [0] * (width - len(r["v"])) for r in seeds], np.int64).reshape(-1, width)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th score among the longest vectors, and the length that a better one needs."""
        for batch in batches:
            ids, q = np.asarray(batch.column(0)).astype(np.int64), matrix(batch.column(1), width)
            floor = np.full(len(ids), NONE)
            block = Block(ids, q, floor, basis, lead, k)
            block.search(seed_ids, seed_v)
            floor = block.best.score[:, -1]
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(floor > 0, floor / block.lengths, 0.0)
            yield pa.record_batch({"vec_id": batch.column(0), "v": batch.column(1), "n": batch.column(2), "floor": pa.array(floor), "needed": pa.array(needed)})

    asked = checkpointed(rows.where("is_query").select("vec_id", "v", "n").mapInArrow(started, "vec_id long, v array<long>, n long, floor long, needed double"))
    edges = asked.agg(F.percentile_approx("needed", [i / CLASSES for i in range(CLASSES)], F.lit(10_000)).alias("e")).first()["e"]
    # Classes of needed lengths, each of as many blocks as its queries ask for; blocks are numbered by what they need.
    edges = sorted({0.0, *(edges or [])})
    counts = {r["c"]: r["n"] for r in asked.groupBy(class_of(F.col("needed"), edges).alias("c")).agg(F.count("*").alias("n")).collect()}
    subs = [-(-counts.get(i, 0) // QUERIES) for i in range(len(edges))]
    starts = [sum(subs[:i]) for i in range(len(edges) + 1)]
    salts = max(1, -(-2 * partitions(spark) // max(1, starts[-1])))
    numbers = lambda x: F.array(*[F.lit(i) for i in x])
    kind = class_of(F.col("needed"), edges)
    block = F.element_at(numbers(starts), kind + 1) + F.pmod(F.xxhash64("n"), F.greatest(F.lit(1), F.element_at(numbers(subs), kind + 1))).cast("int")

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids, v, floor = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64), matrix(batch.column(2), width), np.asarray(batch.column(3)).astype(np.int64)
            for b in np.unique(of).tolist():
                own = of == b
                yield _batch([_packed(b, s, 0, ids[own], v[own], floor[own]) for s in range(salts)], PACKED)

    def pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, v = np.asarray(batch.column(0)).astype(np.int64), matrix(batch.column(1), width)
            for at in range(0, len(ids), CHUNK):
                one = _packed(0, 0, 1, ids[at : at + CHUNK], v[at : at + CHUNK])
                last = starts[int(np.searchsorted(edges, one[3] * (1 + SLACK), side="right"))]
                for b in range(last):
                    yield _batch([(b, (number + b) % salts, *one[2:])], PACKED)
                number += 1

    by_norm = rows.repartitionByRange(partitions(spark), F.desc("sq"), F.xxhash64("n")).sortWithinPartitions(F.desc("sq"), "vec_id")
    packed = asked.select(block.alias("block"), "vec_id", "v", "floor").mapInArrow(pack_queries, PACKED).union(by_norm.select("vec_id", "v").mapInArrow(pack_candidates, PACKED))
    dealt = packed.repartition(partitions(spark), "block", "salt").sortWithinPartitions("block", "salt", "kind", F.desc("longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, open_ = None, [], None, True
        for batch in batches:
            for r in range(batch.num_rows):
                b, s, kind, _, ids, data, floor = (batch.column(i)[r].as_py() for i in range(7))
                ids, data = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, width)
                if (b, s) != at:
                    if block is not None:
                        yield block.found()
                    at, held, block, open_ = (b, s), [], None, True
                if not kind:
                    held.append((ids, data, np.frombuffer(floor, np.int64)))
                elif held and open_:
                    block = block or Block(*[np.concatenate(x) for x in zip(*held, strict=True)], basis, lead, k)
                    open_ = block.search(ids, data)
        if block is not None:
            yield block.found()

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = dealt.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def class_of(needed: Column, edges: list[float]) -> Column:
    """The number of the last of the ascending edges that `needed` reaches."""
    return (F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= needed)) - 1).cast("int")
