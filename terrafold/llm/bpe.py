"""Operator 1: byte-level BPE encoding and decoding.

A segment tree over byte positions stores, per node, the lowest rank of the pairs that begin below it. The root tells
whether a merge is left; walking down to the left on equal ranks finds the leftmost lowest pair; the merge then changes
the leaves of three live neighbours, each in a logarithmic number of nodes. Short pieces run this together, one row of
a matrix each; long ones run it alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NO_PAIR = np.int32(2**31 - 1)
#: Pieces of up to so many bytes are merged together.
TOGETHER = 64
#: Chunks that a Python worker remembers before it starts anew, and the most characters of one; longer ones are encoded
#: each time they come, so what is remembered is bounded in bytes.
REMEMBERED, LONGEST = 200_000, 40
#: Texts that are encoded together.
TEXTS = 250


class Merges:
    """Ranks of a public vocabulary, the pairs that they merge, and the two encoders."""

    def __init__(self, lines: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.decimal = {b: str(b) for b in self.bytes_of}
        #: By chunk, the first without and the second with a space before it: decimal ids, decoded bytes.
        self.seen: dict[str, tuple[str, bytes]] = {}
        self.seen_spaced: dict[str, tuple[str, bytes]] = {}
        #: Chunks among these that are too long to be remembered.
        self.long: list[tuple[dict, str]] = []

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)

    def together(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of at most TOGETHER bytes: one tree a row, one merge a row and round."""
        n = np.array([len(p) for p in pieces])
        leaves = 1 << int(n.max() - 1).bit_length() if n.max() > 1 else 1
        rows = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(rows, leaves)
        live = np.arange(leaves) < n[:, None]
        ids = np.where(live, self.single[flat], -1)
        after = np.tile(np.arange(1, leaves + 1), (rows, 1))
        before = after - 2
        tree = np.full((rows, 2 * leaves), NO_PAIR, np.int32)
        if leaves > 1:
            both = live[:, 1:]
            tree[:, leaves:-1][both] = self.rank(ids[:, :-1][both], ids[:, 1:][both])
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(r: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + leaves
            tree[r, node] = rank
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(r):
            lowest = tree[r, 1]
            node = np.ones(len(r), np.int64)
            while node[0] < leaves:
                node = 2 * node + (tree[r, 2 * node] != lowest)
            left = node - leaves
            right = after[r, left]
            beyond = after[r, right]
            ids[r, left], ids[r, right] = lowest, -1
            after[r, left] = beyond
            put(r, right, np.full(len(r), NO_PAIR))
            some = beyond < n[r]
            rank = np.full(len(r), NO_PAIR)
            rank[some] = self.rank(ids[r[some], left[some]], ids[r[some], beyond[some]])
            before[r[some], beyond[some]] = left[some]
            put(r, left, rank)
            first = before[r, left]
            some = first >= 0
            if some.any():
                q, first = r[some], first[some]
                put(q, first, self.rank(ids[q, first], ids[q, left[some]]))
            r = r[tree[r, 1] != NO_PAIR]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def alone(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, by the same tree in plain lists."""
        n = len(piece)
        leaves = 1 << max(0, (n - 1).bit_length())
        none, pairs = int(NO_PAIR), self.pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pairs.get(ids[i] << 32 | ids[i + 1], none)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int) -> None:
            node = leaf + leaves
            tree[node] = rank
            while node > 1:
                node >>= 1
                lowest = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == lowest:
                    return
                tree[node] = lowest

        while (lowest := tree[1]) != none:
            node = 1
            while node < leaves:
                node *= 2
                if tree[node] != lowest:
                    node += 1
            left = node - leaves
            right = after[left]
            beyond = after[right]
            ids[left], ids[right] = lowest, -1
            after[left] = beyond
            put(right, none)
            if beyond < n:
                before[beyond] = left
                put(left, pairs.get(lowest << 32 | ids[beyond], none))
            else:
                put(left, none)
            if (first := before[left]) >= 0:
                put(first, pairs.get(ids[first] << 32 | lowest, none))
        return [i for i in ids if i >= 0]

    def encoded(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct piece."""
        out: dict[bytes, list[int]] = {}
        short: dict[int, list[bytes]] = {}
        for p in set(pieces):
            if p in self.ranks:
                out[p] = [self.ranks[p]]
            elif len(p) <= TOGETHER:
                short.setdefault((len(p) - 1).bit_length(), []).append(p)
            else:
                out[p] = self.alone(p)
        for same in short.values():
            for i in range(0, len(same), 20_000):
                part = same[i : i + 20_000]
                out.update(zip(part, self.together(part), strict=True))
        return out

    def learn(self, chunks: Iterable[str], spaced: Iterable[str] = ()) -> None:
        """Remember, of chunks not seen yet, the decimal ids and the bytes that they decode to. What is long is forgotten
        when the next chunks come."""
        if len(self.seen) + len(self.seen_spaced) > REMEMBERED:
            self.seen.clear()
            self.seen_spaced.clear()
        for seen, chunk in self.long:
            seen.pop(chunk, None)
        self.long.clear()
        for seen, before, wanted in ((self.seen, "", chunks), (self.seen_spaced, " ", spaced)):
            new = list(set(wanted).difference(seen))
            pieces = [[p.encode() for p in self.split(before + c)] for c in new]
            ids = self.encoded(p for ps in pieces for p in ps)
            decimal, text = self.decimal, self.bytes_of
            for chunk, ps in zip(new, pieces, strict=True):
                own = ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]]
                seen[chunk] = ",".join([decimal[i] for i in own]), b"".join([text[i] for i in own])
                if len(chunk) > LONGEST:
                    self.long.append((seen, chunk))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        pieces = [p.encode() for p in self.split(text)]
        ids = self.encoded(pieces)
        return [i for p in pieces for i in ids[p]]


#: A space before white space, by the widest notion of it.
SPACE_RUN = re.compile(r" \s").search
#: Before a space that follows a letter, a digit or a mark: no match of the pattern holds both.
AFTER_WORD = regex.compile(r"(?V1)(?<=[\p{L}\p{N}\p{P}])(?= )").split


def chunks_of(text: str) -> tuple[str, list[str]]:
    """text cut before spaces: the first chunk, and the others without the space that they begin with. A space and what
    follows belong to one match of the pattern whenever the next character is no white space, so a cut before a single
    space lies between two matches; a text with a space before other white space is cut after words alone."""
    if SPACE_RUN(text):
        first, *rest = AFTER_WORD(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


_LOADED: dict[int, Merges] = {}


def loaded(lines: bytes) -> Merges:
    """One table a Python worker, kept from task to task."""
    key = hash(lines)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Merges(lines)
    return _LOADED[key]


def token_ids(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with an array of the ids of each whole text (null: no ids)."""
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        merges = loaded(lines.value)
        return pd.Series([merges.encode(t or "") for t in texts])

    return df.withColumn(out, run(F.col(text)))


def decoded_text(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the bytes that each array of ids stands for (null: null)."""
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        merges = loaded(lines.value)
        return pd.Series([None if a is None else merges.decode(list(a)) for a in arrays])

    return df.withColumn(out, run(F.col(ids)))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (an array) for every row of docs.

    A null text counts as empty; the empty text has no ids. Repeated rows give repeated rows, extra columns are left out,
    an empty table gives an empty one. One scan, no shuffle. The vocabulary is a file of fixed size; it is broadcast, so
    executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(lines.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                own = batch.slice(at, TEXTS)
                part = [chunks_of(t or "") for t in own.column(1).to_pylist()]
                merges.learn([a for a, _ in part], set().union(*[b for _, b in part]))
                first, get = merges.seen, merges.seen_spaced.__getitem__
                n, ids_of, texts, arrays = [], [], [], []
                for a, rest in part:
                    decimal, text = zip(first[a], *map(get, rest), strict=True)
                    numbers = ",".join(decimal if a else decimal[1:])
                    n.append(numbers.count(",") + 1 if numbers else 0)
                    ids_of.append(hashlib.sha256(numbers.encode()).hexdigest())
                    texts.append(hashlib.sha256(b"".join(text)).hexdigest())
                    if ids:
                        arrays.append(np.fromstring(numbers, np.int32, sep=",") if numbers else np.zeros(0, np.int32))
                out = {"doc_id": own.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_of, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
                yield pa.record_batch(out | ({"ids": pa.array(arrays, pa.list_(pa.int32()))} if ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema + (", ids array<int>" if ids else ""))
