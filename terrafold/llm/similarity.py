"""Operator 4: an n-gram Jaccard join by prefix trees, and the classes that its links connect.

1. Each document becomes the set of its hashed shingles. Equal sets are one class from here on.
2. A global order of shingles: first a hash-chosen share of them, rarest first by exact document counts; then the
   rest by hash; last those that a table of counters shows to be very frequent. By any such order two similar sets
   share a shingle among their first few, so only sets that do can be linked.
3. Sets that share such a shingle and have similar sizes are joined into blocks, through the least set of each shingle
   and size class, so no pairs within a group are written out.
4. The sets of a block are stored in a trie by the block's own order and each set walks it, sharing overlaps along
   common beginnings and leaving subtrees whose remaining lengths can't reach the overlap needed, or whose sets are
   all connected with it already.
5. Large blocks are dealt out in chunks. Then one set of each component that a chunk found stands for it, and these are
   joined. What may still link is only in groups of a shared shingle whose sets are in several components and chunks;
   the sets of such groups make new, smaller blocks, which are joined the same way.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path, removed
from .common import checkpointed, fresh, partitions, shingles, small_batches, tidied, written

#: Counters that find very frequent shingles, and how many times the mean makes one of them frequent.
SLOTS, FREQUENT, LEAST_FREQUENT = 1 << 18, 8, 64
#: The most shingles, about, that one task gets of a block.
CHUNK = 500_000
#: Bits that tell which rows are needed in blocks; of more rows some unneeded ones are read too.
BITS = 1 << 24


def least_common(n: np.ndarray, least: Fraction) -> np.ndarray:
    """How many of n shingles a similar set must share at least: the ceiling of least * n."""
    return -(-n * least.numerator // least.denominator)


def digest(tokens: np.ndarray) -> bytes:
    """Names a set of shingles."""
    return hashlib.md5(tokens.tobytes()).digest()


def key_of(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _texts(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*[batch.column(c).slice(at, 256).to_pylist() for c in columns], strict=True)


def _once(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[str, np.ndarray, bytes]]:
    """Texts with their sets and names, each set but once a task: copies end here, before any shuffle."""
    seen = set()
    for (text,) in _texts(batches, "text"):
        tokens = shingles(text, k)
        if len(tokens) and (name := digest(tokens)) not in seen:
            seen.add(name)
            yield text, tokens, name


def members(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, g, n, name, key) of every row, h and g being hashes of its text and key the first half of the name, and
    (slot, count) of the shingles of all rows, from one pass."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            n, names = [], []
            for (text,) in _texts([batch], "text"):
                tokens = shingles(text, k)
                n.append(len(tokens))
                names.append(name := digest(tokens))
                if name not in seen:
                    seen.add(name)
                    np.add.at(counts, (tokens & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            own = {c: batch.column(c) for c in ("doc_id", "h", "g")}
            yield pa.record_batch(own | {"n": pa.array(n, pa.int64()), "name": pa.array(names, pa.binary()), "key": pa.array(map(key_of, names), pa.int64()), "slot": pa.nulls(len(n), pa.int32()), "count": pa.nulls(len(n), pa.int64())})
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            empty = {c: pa.nulls(len(part), t) for c, t in (("doc_id", pa.int64()), ("h", pa.int64()), ("g", pa.int32()), ("n", pa.int64()), ("name", pa.binary()), ("key", pa.int64()))}
            yield pa.record_batch(empty | {"slot": pa.array(part, pa.int32()), "count": pa.array(counts[part])})

    both = written(docs.mapInArrow(tidied(run), "doc_id long, h long, g int, n long, name binary, key long, slot int, count long"), "members")
    return both.where("slot is null").select("doc_id", "h", "g", "n", "name", "key"), both.where("slot is not null").select("slot", "count")


def frequent_slots(counts: DataFrame) -> np.ndarray:
    """Which counters are frequent. At most SLOTS / FREQUENT can be, so few numbers reach the driver."""
    total = counts.groupBy("slot").agg(F.sum("count").alias("count"))
    mean = (total.agg(F.sum("count")).first()[0] or 0) / SLOTS
    out = np.zeros(SLOTS, bool)
    out[[r["slot"] for r in total.where(F.col("count") > max(LEAST_FREQUENT, FREQUENT * mean)).select("slot").collect()]] = True
    return out


def postings(docs: DataFrame, k: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(token, key, n, spare, sure): the shingles of each set that can be among its first in the global order.

    key: the first half of the set's name. spare: how many of the set's ordered-by-count shingles there are. sure: the
    shingle is among the first whatever the counts are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    share = np.uint64(min(256, int(256 * 2.5 * (1 - least)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = ~shared.value
        held, rows = [], 0
        for _, tokens, name in _once(batches, k):
            n = len(tokens)
            first = n - int(least_common(n, least)) + 1
            light = rare[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
            counted = light & ((tokens >> np.uint64(40)) & np.uint64(255) < share)
            own = tokens[counted]
            sure = len(own) <= first
            if len(own) < first:
                rest = np.concatenate([tokens[light & ~counted], tokens[~light]])
                own = np.concatenate([own, rest[: first - len(own)]])
            held.append((own, key_of(name), n, int(counted.sum()), sure))
            rows += len(own)
            if rows > 100_000:
                yield batch(held)
                held, rows = [], 0
        if held:
            yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        n = np.array([len(h[0]) for h in held])
        spread = lambda i, kind: pa.array(np.repeat(np.array([h[i] for h in held], kind), n))
        return pa.record_batch({"token": pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), "key": spread(1, np.int64), "n": spread(2, np.int32), "spare": spread(3, np.int32), "sure": spread(4, bool)})

    return docs.select("text").mapInArrow(tidied(run), "token long, key long, n int, spare int, sure boolean")


def candidates(posted: DataFrame, least: Fraction) -> DataFrame:
    """(token, key, n): of each set the first shingles that another set has too. Counts come from a window, since adding up
    nearly distinct shingles on the map side fills the executors' memory for nothing."""
    by_token = Window.partitionBy("token")
    shared = (
        posted.withColumn("df", F.count("*").over(by_token))
        .withColumn("several", F.min("key").over(by_token) != F.max("key").over(by_token))
        .where("several")
    )
    # Shingles that no other set has come first of all and need no posting; they take up places, though.
    place = F.dense_rank().over(Window.partitionBy("key").orderBy("df", "token"))
    first = F.col("n") - F.ceil(F.lit(least.numerator) * F.col("n") / F.lit(least.denominator)) + 1
    ranked = shared.withColumn("place", place).withColumn("others", F.col("spare") - F.max("place").over(Window.partitionBy("key")))
    return ranked.where(F.col("sure") | (F.col("place") <= first - F.col("others"))).select("token", "key", "n")


def grouped(found: DataFrame, least: Fraction) -> DataFrame:
    """found with size_class: sets that may link have a shingle and a size class in common, as each is in two classes."""
    width = float(-np.log(float(least))) * 1.0001
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    return found.withColumn("size_class", F.explode(F.array(size_class, size_class + 1)))


def edges(found: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): sets of the same shingle and of neighbouring size classes, each joined to the least of them."""
    spread = grouped(found, least)
    hubs = spread.groupBy("token", "size_class").agg(F.min("key").alias("hub"), F.max("key").alias("far")).where("hub <> far")
    return spread.join(hubs.drop("far"), ["token", "size_class"]).where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every u that has links (u, v), u > root; root is the least of its component and has no row.

    Large-star and small-star steps in turn: each vertex's larger neighbours, then its smaller ones, move to the least
    of its neighbourhood, until nothing moves. The rows never outnumber the links.
    """
    spark = links.sparkSession

    def stored(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "links")
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, e = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == seen or not total[0]:
            return e.select("u", F.col("v").alias("root"))
        seen = tuple(total)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, (path, e) = path, stored(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        removed(spark, before)


class Node:
    """A run of shingles that all sets below share; `at` is a set that ends here."""

    __slots__ = ("at", "below", "longest", "member", "one", "run")

    def __init__(self, run: array, longest: int, member: int):
        self.run, self.below, self.at = run, {}, []
        self.longest, self.member, self.one = longest, member, True


class Trie:
    """Sets of shingles in one order, with the components that links connect them to."""

    def __init__(self, least: Fraction, n: int):
        self.least, self.root, self.up = least, Node(array("i"), 0, -1), list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.up[j] = i

    def needed(self, a: int, b: int) -> int:
        """The least overlap of similar sets of a and b shingles."""
        t, d = self.least.numerator, self.least.denominator
        return -(-t * (a + b) // (t + d))

    def add(self, i: int, order: array) -> None:
        """Link set i with those stored that are similar and not connected with it yet, then store it. Sets come by
        ascending length."""
        n = len(order)
        own = dict(zip(order, range(n), strict=True))
        t, d = self.least.numerator, self.least.denominator
        shortest = -(-t * n // d)
        stack = [(self.root, 0, 0, 0)]  # node, depth and overlap above it, place in the set that is passed
        while stack:
            node, depth, common, passed = stack.pop()
            if node.longest < shortest and node is not self.root:
                continue
            if node.member >= 0 and node.one and self.find(node.member) == self.find(i):
                continue
            # What a stored set below may lack or have besides: it is at least `shortest` long, so similar ones
            # share enough; the bound uses the longest below, which asks the least extra and allows the most.
            ok = True
            for token in node.run:
                depth += 1
                if (at := own.get(token)) is not None:
                    common, passed = common + 1, at + 1
                elif common + min(n - passed, node.longest - depth) < self.needed(n, max(shortest, depth)):
                    ok = False
                    break
            if not ok or common + min(n - passed, node.longest - depth) < self.needed(n, max(shortest, depth)):
                continue
            for j in node.at:
                if common >= self.needed(n, depth) and self.find(i) != self.find(j):
                    self.unite(i, j)
            stack.extend((x, depth, common, passed) for x in node.below.values())
        self.store(i, order)

    def store(self, i: int, order: array) -> None:
        node, at, n = self.root, 0, len(order)
        mine = self.find(i)

        def pass_by(x: Node) -> None:
            x.longest = max(x.longest, n)
            if x.member < 0:
                x.member = i
            x.one = x.one and self.find(x.member) == mine

        pass_by(node)
        while at < n:
            child = node.below.get(order[at])
            if child is None:
                leaf = Node(order[at:], n, i)
                leaf.at.append(i)
                node.below[order[at]] = leaf
                return
            run, same = child.run, 0
            while same < len(run) and at + same < n and run[same] == order[at + same]:
                same += 1
            if same < len(run):
                top = Node(run[:same], child.longest, child.member)
                top.one = child.one
                child.run = run[same:]
                top.below[child.run[0]] = child
                node.below[order[at]] = top
                child = top
            node, at = child, at + same
            pass_by(node)
        node.at.append(i)


def linked(sets: list[np.ndarray], least: Fraction, known: list[int] | None = None) -> list[int]:
    """The component of each set: the number of its first member. known: components that are connected already."""
    trie = Trie(least, len(sets))
    for i, j in enumerate(known or []):
        trie.unite(i, j)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    kinds, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    # Frequent shingles first: similar sets then begin alike and share their way down.
    rank = np.empty(len(kinds), np.int32)
    rank[np.lexsort((kinds, -count))] = np.arange(len(kinds), dtype=np.int32)
    ranks = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    del every, kinds, inverse, count, rank
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        trie.add(i, array("i", np.sort(ranks[i]).tobytes()))
    return [trie.find(i) for i in range(len(sets))]


def joined(rows: DataFrame, k: int, least: Fraction) -> DataFrame:
    """(name, root): of rows (part, name, label, text) the sets of each part that links connect, with the least name.
    Sets of equal label are connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, sets, labels, out = None, [], [], [], ([], [])

        def close() -> None:
            if len(sets) < 2:
                return
            first: dict = {}
            known = [first.setdefault(a, i) if a is not None else i for i, a in enumerate(labels)]
            roots: dict[int, list[int]] = {}
            for i, r in enumerate(linked(sets, least, known)):
                roots.setdefault(r, []).append(i)
            for same in roots.values():
                low = min(names[i] for i in same)
                out[0].extend(names[i] for i in same if names[i] != low)
                out[1].extend(low for i in same if names[i] != low)

        def flush() -> pa.RecordBatch:
            made = pa.record_batch({"name": pa.array(out[0], pa.binary()), "root": pa.array(out[1], pa.binary())})
            out[0].clear()
            out[1].clear()
            return made

        for p, name, label, text in _texts(batches, "part", "name", "label", "text"):
            if p != part:
                close()
                part = p
                names.clear(), sets.clear(), labels.clear()
                if len(out[0]) > 10_000:
                    yield flush()
            if not names or names[-1] != name:
                names.append(name), sets.append(shingles(text, k)), labels.append(label)
        close()
        yield flush()

    shaped = rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "name")
    return shaped.select("part", "name", "label", "text").mapInArrow(tidied(run), "name binary, root binary")


def classes(docs: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Documents link when their sets of k-word shingles have a Jaccard similarity of at least `least`; component_id is
    the smallest doc_id that links reach. A null text, an empty one and one without words have no shingles and link
    with nothing; one with fewer than k words has the whole sequence as its shingle. Rows that repeat a doc_id are
    classed by their texts, each for itself; a null doc_id is never the smallest. Extra columns are left out.
    """
    return classed(docs, k, least).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """The packed bits of the hashes in the one column of keys. Each of 16 tasks sets the bits of its own ranges, so what
    reaches the driver is one bitmap in all."""
    wide = BITS >> 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(0)).astype(np.int64)
            for r in np.unique(at // wide).tolist():
                held.setdefault(r, np.zeros(wide, bool))[at[at // wide == r] % wide] = True
        yield pa.record_batch({"range": pa.array(list(held), pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())})

    slots = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(BITS)).alias("slot")).distinct()
    out = np.zeros(BITS >> 3, np.uint8)
    for r in slots.repartition(16, F.floor(F.col("slot") / wide)).mapInArrow(run, "range long, bits binary").collect():
        out[r["range"] * (wide >> 3) : (r["range"] + 1) * (wide >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def asked_for(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is among keys (one column), and a few others: what a join would drop ends here, before a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys))

    @F.pandas_udf("boolean")
    def asked(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy() & (BITS - 1)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0)

    return rows.where(asked(key))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, h, g, ...) with the text of its document. Rows of docs that aren't asked for, and repeated ones within
    a task, end before the shuffle."""
    key = F.xxhash64("doc_id", "h", "g")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keep = []
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "h", "g")], strict=True)):
                if row not in seen:
                    seen.add(row)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = asked_for(docs, key, wanted.select(key.alias("k"))).mapInArrow(tidied(once), "doc_id long, text string, h long, g int").select(F.col("doc_id").alias("_d"), "text", F.col("h").alias("_h"), F.col("g").alias("_g"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    return wanted.join(rows, same).drop("doc_id", "h", "g", "_d", "_h", "_g")


def classed(docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """doc_id, n, name, root, component_id for every row of docs: how many shingles, the name of their set, the name that
    stands for the class, and its smallest doc_id; without shingles the last two are null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    of, counts = members(docs, k)
    found = written(candidates(postings(docs, k, least, frequent_slots(counts)), least), "found")
    root = components(edges(found, least))
    block = root.select(F.col("u").alias("key"), "root").union(root.select(F.col("root").alias("key"), "root").distinct())

    # One row of docs stands for each set.
    reps = of.where("n > 0").groupBy("name").agg(F.min(F.struct("doc_id", "h", "g")).alias("rep"), F.first("n").alias("n"), F.first("key").alias("key"))
    wanted = checkpointed(reps.join(block, "key").select("rep.*", "name", "n", "key", "root"))
    in_blocks = written(texts_of(docs, wanted), "blocks")
    link = connected(in_blocks, found, k, least)

    least_id = of.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least_id"))
    of_name = least_id.join(link, "name", "left").withColumn("root", F.coalesce("root", "name"))
    of_root = of_name.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = of_name.join(of_root, "root").select(F.col("name").alias("its"), "root", "component_id")
    got = of.join(component, (F.col("name") == F.col("its")) & (F.col("n") > 0), "left")
    return got.select("doc_id", "n", "name", "root", "component_id")


def chunked(rows: DataFrame, seed: str) -> DataFrame:
    """rows (root, name, n) with chunks, how many their block needs, and own, the number of the one they are in."""
    sizes = rows.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("chunks"))
    return rows.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("name", F.lit(seed)), F.col("chunks")).cast("int"))


def in_parts(rows: DataFrame, k: int, least: Fraction) -> DataFrame:
    """What `joined` finds in rows (root, own, name, label, text), each chunk of each block being a part."""
    return joined(rows.withColumn("part", F.concat_ws(":", "root", "own")), k, least)


def connected(in_blocks: DataFrame, found: DataFrame, k: int, least: Fraction) -> DataFrame:
    """(name, root) of the sets that links connect with one of a lesser name; in_blocks: name, n, key, root, text."""
    none = F.lit(None).cast("binary")
    dealt = chunked(in_blocks, "first")
    link = written(in_parts(dealt.withColumn("label", none), k, least), "link")
    large = checkpointed(dealt.where("chunks > 1").drop("text").distinct())
    if not large.limit(1).count():
        return link

    def with_labels(rows: DataFrame) -> DataFrame:
        return rows.join(link.select("name", F.col("root").alias("label")), "name", "left").withColumn("label", F.coalesce("label", "name"))

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(in_blocks.select("name", "text"), "name")

    def relabelled(moved: DataFrame) -> DataFrame:
        """link after components moved (name, root) to others; the sets that name them get rows of their own."""
        to = moved.select(F.col("name").alias("from"), F.col("root").alias("to"))
        kept = link.join(to, F.col("root") == F.col("from"), "left").select("name", F.coalesce("to", "root").alias("root"))
        return written(kept.union(moved.select("name", "root")), "link")

    # A set is in one part here, so what is found is settled without further steps.
    heads = chunked(with_labels(large).where("name = label").drop("chunks", "own"), "heads")
    link = relabelled(written(in_parts(with_text(heads), k, least), "heads"))

    # Pairs of one chunk are settled, so only groups of several components in several chunks can still hold a link.
    spread = grouped(asked_for(found, F.col("key"), large.select("key")), least).join(with_labels(large).select("key", "label", "own"), "key")
    ends = [f(c).alias(f"{c}_{n}") for c in ("label", "own") for n, f in (("a", F.min), ("b", F.max))]
    groups = spread.groupBy("token", "size_class").agg(F.min("key").alias("hub"), *ends).where("label_a <> label_b and own_a <> own_b")
    active = written(spread.join(groups.select("token", "size_class", "hub"), ["token", "size_class"]).select("key", "hub").distinct(), "active")
    if not active.limit(1).count():
        return link
    root = components(active.where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v")))
    block = root.select(F.col("u").alias("key"), "root").union(root.select(F.col("root").alias("key"), "root").distinct())
    rest = chunked(with_labels(large).drop("root", "chunks", "own").join(block, "key"), "rest")
    # A block that still is too large for a task: its chunks meet in pairs, each set in as many parts as there are chunks.
    pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunks = 1 or own <> other")
    pairs = pairs.withColumn("own", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")))
    more = in_parts(with_text(pairs), k, least)
    label = with_labels(large).select(F.col("name").alias("set"), "label").distinct()
    both = more.join(label, F.col("name") == F.col("set")).select(F.col("label").alias("u"), "root").join(label, F.col("root") == F.col("set")).select("u", F.col("label").alias("v"))
    moved = components(both)
    return relabelled(moved.select(F.col("u").alias("name"), "root"))


def keep_one(docs: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs, with its columns, that stay when of each class of near copies one row stays: that of the smallest
    doc_id, null ones last, and of rows that share it the smallest text. Classes are of rows, so a doc_id with unrelated
    texts may stay several times, or not at all; rows without words are each a class of its own and stay."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        own = fresh(docs, "kept")
        kept = classes(docs, k, least).where("doc_id = component_id").select(F.col("doc_id").alias(own))
        return docs.join(kept, F.col("doc_id") == F.col(own), "left_semi")

    @F.pandas_udf("binary")
    def set_name(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(tokens) if len(tokens := shingles(t, k)) else None for t in texts], dtype=object)

    its, kept, root, name, turn = (fresh(docs, c) for c in ("its", "kept", "root", "name", "turn"))
    rows = classed(docs, k, least).where("n > 0 and doc_id <=> component_id")
    first = rows.select(F.col("name").alias(its), F.col("doc_id").alias(kept), F.col("root").alias(root)).distinct()
    named = docs.withColumn(name, set_name("text"))
    of = named.join(first, (F.col(name) == F.col(its)) & F.col("doc_id").eqNullSafe(F.col(kept)))
    one = of.withColumn(turn, F.row_number().over(Window.partitionBy(root).orderBy("text"))).where(F.col(turn) == 1)
    return one.select(*docs.columns).unionByName(named.where(F.col(name).isNull()).select(*docs.columns))
