"""Operator 5: token ids in binary files, compressed by Re-Pair grammars.

Documents are encoded, dealt to shards by ranges of doc_id, and each shard's ids become a grammar: again and again the
frequent pairs of neighbouring ids are replaced by new symbols, until none is frequent. A shard stores the rules, how
many ids each symbol expands to, and what is left of the sequence in blocks of their own with an index, so any span of
ids can be decoded from the blocks that hold it.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path
from .bpe import SPACE_RUN, chunks_of
from .common import mixed

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: A shard is closed when it holds so many ids; a document isn't divided, so one of more ids makes its shard longer.
SHARD = 1_000_000
#: A pair is replaced while it occurs so often without overlap. A rule takes three numbers (two symbols and a length), so
#: one for a rarer pair would take at least as much as it saves.
LEAST = 4
#: Symbols of the remaining sequence that are compressed together.
BLOCK = 8192
#: Chunks that a Python worker remembers in each of two generations, and the most characters of one; longer ones are
#: encoded each time they come.
REMEMBERED, LONGEST = 400_000, 40
#: Slots for chunks that a worker finds by their hashes, and the most chunks and bytes that are held for them.
SLOTS, HELD, HELD_BYTES = 1 << 21, 2 * REMEMBERED, 1 << 26
#: Characters that are cut and looked up together, and new pieces that the library's model takes at once.
PART, TOGETHER = 1 << 19, 100
MAGIC = b"RPG2"
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
#: Bytes at the first so many places of a chunk have values of their own in its hash.
_PLACES = 64
_VALUES = mixed(np.arange(256 * _PLACES, dtype=np.uint64) + np.uint64(1))


def mapped_bytes() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """What a function gives for recent keys: a dictionary in two generations, so that frequent keys stay. Keys that are long
    or go over lines, and so seldom come again, are not kept."""

    def __init__(self, made, most: int = REMEMBERED):
        super().__init__()
        self.made, self.most, self.older = made, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= LONGEST and "\n" not in key:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts by the tokenizers library, each recent chunk once. A chunk of letters, with or without marks after
    it, is one or two pieces of the pattern, which go to the library's model directly; other chunks are cut by the
    pattern; texts that may hold a special token go to the whole tokenizer. `encode_all` finds the chunks of
    many texts together and gives new pieces to the model together; `encode` takes one text, however it is spaced."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        self.special = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.mapped = str.maketrans(mapped_bytes())
        self.space = " ".translate(self.mapped)
        self.spaced = Recent(self.chunk)
        self.bare = Recent(self.plain)
        self.piece = Recent(self.ids, REMEMBERED // 3)
        self.line = self.ids("\n")
        self.known = Known(self.encode_chunks)
        characters = mapped_bytes()
        self.characters = np.array([ord(characters[b]) for b in range(256)], "<u2")
        # A byte that is in no UTF-8 and, by the vocabulary, in no merge.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        within = set().union(*(t for t in vocabulary if len(t) > 1))
        walls = [b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if characters[b] in vocabulary and characters[b] not in within]
        self.wall, self.wall_id = (bytes([walls[0]]), vocabulary[characters[walls[0]]]) if walls else (None, -1)

    def ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.mapped))]).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk with a space before it."""
        core = text.rstrip(_MARKS)
        if core.isalpha():
            if len(core) < len(text):
                return self.spaced[core] + self.piece[text[len(core) :]]
            if text.isascii():
                return array("I", [t.id for t in self.merge(self.space + text)]).tobytes()
            return self.ids(" " + text)
        lines = text.split("\n")
        if len(lines) > 1 and text.split() == lines:
            # A line break between words is a piece of its own.
            return self.line.join([self.spaced[lines[0]], *map(self.bare.__getitem__, lines[1:])])
        return self.plain(" " + text)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers."""
        if any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, rest = chunks_of(text)
        return self.plain(first) + b"".join(map(self.spaced.__getitem__, rest))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library's model, and how many each has. The model takes some pieces at once with the wall
        after each, so what it makes of one doesn't depend on the others."""
        if self.wall is None:
            each = [np.frombuffer(self.ids(p.decode()), np.uint32) for p in pieces]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        ids: list[int] = []
        for i in range(0, len(pieces), TOGETHER):
            raw = np.frombuffer(self.wall.join([*pieces[i : i + TOGETHER], b""]), np.uint8)
            ids += [t.id for t in self.merge(self.characters[raw].tobytes().decode("utf-16-le"))]
        found = np.array(ids, np.uint32)
        walls = found == self.wall_id
        return found[~walls], np.diff(np.flatnonzero(walls), prepend=-1) - 1

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and how many each has."""
        pieces: list[bytes] = []
        counts: list[int] = []
        for chunk in chunks:
            text = chunk.decode()
            if (text[1:] if text[0] == " " else text).isalpha():
                pieces.append(chunk)
                counts.append(1)
            else:
                cut = self.cut(text)
                pieces += [p.encode() for p in cut]
                counts.append(len(cut))
        ids, sizes = self.merged(pieces)
        return ids, sums(sizes, np.array(counts))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of whole texts as unsigned 32-bit integers. Texts in which each space is followed by what is no white space
        are cut and looked up together; others go one by one."""
        out: list[list[bytes]] = []
        parts: list[bytes] = []
        owners: list[int] = []
        held = 0

        def settle() -> None:
            for i, ids in zip(owners, self.known.encode(parts) if parts else (), strict=True):
                out[i].append(ids)
            parts.clear()
            owners.clear()

        for text in texts:
            out.append([])
            if text.endswith(" ") or SPACE_RUN(text) or any(x in text for x in self.special):
                out[-1].append(self.encode(text))
                held += len(text)
            else:
                at = 0
                while at < len(text):
                    if at:
                        settle()
                    # A long text is taken in parts that end before a space.
                    end = text.find(" ", at + PART) if len(text) - at > PART else -1
                    end = len(text) if end < 0 else end
                    parts.append(text[at:end].encode())
                    owners.append(len(out) - 1)
                    held, at = held + end - at, end
            if held >= PART:
                settle()
                yield from map(b"".join, out)
                out.clear()
                held = 0
        settle()
        yield from map(b"".join, out)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of as many neighbouring values as counts say."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[np.cumsum(counts)], prepend=0)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places from each start on, n of each."""
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat(start - (ends - n), n)
    at += np.arange(len(at))
    return at


def alike(a: np.ndarray, start: np.ndarray, n: np.ndarray, b: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which spans of a hold the same bytes as those of b."""
    out = n == m
    some = np.flatnonzero(out)
    n = n[some]
    differ = a[spans(start[some], n)] != b[spans(other[some], n)]
    if differ.any():
        out[some[np.repeat(np.arange(len(some)), n)[differ]]] = False
    return out


class Known:
    """Ids of recent chunks by their bytes. The hash of a chunk gives a slot, the slot the last chunk that took it; whether
    that is the same is decided by the bytes. Chunks that aren't found are made, each once."""

    def __init__(self, made):
        self.made = made
        self.slot = np.zeros(SLOTS, np.int32)
        #: Of each chunk its bytes, ids and their places; the first is none.
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.at, self.n, self.start, self.size = (np.zeros(1, np.int64) for _ in range(4))

    def add(self, data: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.at = np.append(self.at, len(self.data) + np.cumsum(n) - n)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.n, self.size = np.append(self.n, n), np.append(self.size, size)
        self.data, self.ids = np.append(self.data, data), np.append(self.ids, ids)

    def forget(self) -> None:
        """Keep the newer half of what can be held, if that is exceeded."""
        if len(self.n) <= HELD and len(self.data) + 4 * len(self.ids) <= HELD_BYTES:
            return
        full = np.flatnonzero(self.slot)
        number = self.slot[full]
        order = np.argsort(-number)[: HELD // 2]
        order = order[np.cumsum(self.n[number[order]] + 4 * self.size[number[order]]) <= HELD_BYTES // 2][::-1]
        full, number = full[order], number[order]
        n, size = self.n[number], self.size[number]
        data, ids = self.data[spans(self.at[number], n)], self.ids[spans(self.start[number], size)]
        self.data, self.ids = data[:0], ids[:0]
        self.at, self.n, self.start, self.size = (np.zeros(1, np.int64) for _ in range(4))
        self.add(data, n, ids, size)
        self.slot[:] = 0
        self.slot[full] = np.arange(1, len(number) + 1)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that aren't empty, as unsigned 32-bit integers.

        Cuts lie before spaces, before a mark after an ASCII letter or digit, and before a line break after one of these or
        a mark: no match of the pattern reaches across any of them.
        """
        raw = b"".join(texts)
        data, length = np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts])
        begin = np.cumsum(length) - length
        alnum, mark, line = _ALNUM[data], _MARK[data], data == 10
        cut = data == 32
        cut[1:] |= (mark | line)[1:] & alnum[:-1] | line[1:] & mark[:-1]
        cut[begin] = True
        start = np.flatnonzero(cut)
        n = np.diff(start, append=len(data))
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(start.astype(np.int32), n)
        np.minimum(place, _PLACES - 1, out=place)
        place <<= 8
        place |= data
        h = mixed(np.add.reduceat(_VALUES[place], start))
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        number = self.slot[slot].astype(np.int64)
        new = np.flatnonzero(~alike(data, start, n, self.data, self.at[number], self.n[number]))
        if len(new):
            # Of equal hashes the first is made; what has other bytes than that, too.
            new = new[np.argsort(h[new], kind="stable")]
            fresh = np.append(True, h[new[1:]] != h[new[:-1]])
            first = new[np.maximum.accumulate(np.where(fresh, np.arange(len(new)), 0))]
            fresh |= ~alike(data, start[new], n[new], data, start[first], n[first])
            own = new[fresh]
            made = len(self.n) + np.cumsum(fresh) - 1
            # A chunk that equals the first of its hash has that one's number, whatever lies between.
            of = np.zeros(len(start), np.int64)
            of[new] = made
            number[new] = np.where(fresh, made, of[first])
            a, b = start[own].tolist(), (start[own] + n[own]).tolist()
            ids, size = self.made([raw[i:j] for i, j in zip(a, b, strict=True)])
            self.add(data[spans(start[own], n[own])], n[own], ids, size)
            short = own[n[own] <= LONGEST]
            self.slot[slot[short]] = number[short]
        size = self.size[number]
        out = self.ids[spans(self.start[number], size)].astype("<u4").tobytes()
        ends = 4 * np.append(0, np.cumsum(size))[np.append(np.searchsorted(start, begin), len(start))]
        self.forget()
        return [out[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[int, Encoder] = {}


def loaded(definition: str) -> Encoder:
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(definition)
    return _LOADED[key]


def grammar(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """The first new symbol, the rules as pairs of symbols, and the sequence that is left of ids, in which no pair occurs
    `least` times without overlap.

    A round counts the pairs that may be frequent, and replaces those that outdo the pairs that overlap them by their
    counts: the most frequent pair of all is replaced wherever it occurs, and so are others that don't touch it. Only
    pairs of new symbols can become frequent, so later rounds look at these and at what was frequent and is left.
    """
    first = int(ids.max(initial=0)) + 1
    made, seq, total = [np.zeros((0, 2), np.int64)], ids.astype(np.int32), first
    at = np.arange(max(0, len(seq) - 1), dtype=np.int32)
    while len(at):
        whole, odd = len(at) == len(seq) - 1, at[:0]
        left, right = (seq[:-1], seq[1:]) if whole else (seq[at], seq[at + 1])
        if len(same := np.flatnonzero(left == right)):
            # Of pairs that overlap in a run of one symbol every other one counts, from the left.
            runs = np.flatnonzero(np.append(True, np.diff(at[same]) != 1))
            place = np.arange(len(same)) - np.repeat(runs, np.diff(np.append(runs, len(same))))
            odd = at[same[place % 2 == 1]]
            rest = np.ones(len(at), bool)
            rest[same[place % 2 == 1]] = False
            at, left, right = at[rest], left[rest], right[rest]
        # Pair and place in one number, so that one sort of plain numbers brings equal pairs together.
        wide, long = total.bit_length(), len(at).bit_length()
        code = left.astype(np.int64)
        code <<= wide
        code |= right
        if 2 * wide + long < 64:
            code <<= long
            code |= np.arange(len(at))
            code.sort()
            ordered, order = code >> long, code & ((1 << long) - 1)
        else:
            order = np.argsort(code, kind="stable")
            ordered = code[order]
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(start, len(ordered)))
        some = np.repeat(count >= least, count)
        kind = np.full(len(at), -1, np.int32)
        kind[order[some]] = np.repeat(np.arange(len(start), dtype=np.int32)[count >= least], count[count >= least])
        at, kind = at[kind >= 0], kind[kind >= 0]
        if not len(at):
            break
        worth = (count << 32 | np.arange(len(start)))[kind]
        touching, up = np.diff(at) == 1, worth[1:] > worth[:-1]
        wins = np.ones(len(at), bool)
        wins[:-1] &= ~(touching & up)
        wins[1:] &= ~(touching & ~up)
        enough = np.bincount(kind[wins], minlength=len(start)) >= least
        wins &= enough[kind]
        new = np.flatnonzero(enough)
        symbol = np.zeros(len(start), np.int32)
        symbol[new] = total + np.arange(len(new))
        pairs = ordered[start[new]]
        made.append(np.stack([pairs >> wide, pairs & ((1 << wide) - 1)], axis=1))
        where = at[wins]
        seq[where] = symbol[kind[wins]]
        look, keep = np.zeros(len(seq), bool), np.ones(len(seq), bool)
        look[at] = look[odd] = True
        keep[where + 1] = False
        seq, look = seq[keep], look[keep]
        fresh = seq >= total
        look |= fresh
        look[:-1] |= fresh[1:]
        total += len(new)
        at = np.flatnonzero(look[:-1]).astype(np.int32)
    return first, np.concatenate(made), seq


def lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each new symbol expands to; rules refer to earlier rules only."""
    out: list[int] = []
    for a, b in (rules - first).tolist():
        out.append((out[a] if a >= 0 else 1) + (out[b] if b >= 0 else 1))
    return np.array(out, np.int64)


def expand(first: int, rules: np.ndarray, size: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: each symbol's place is known from the lengths, so only what is no id yet is
    replaced, level by level."""
    rules, size, seq = rules.astype(np.int32), size.astype(np.int32), seq.astype(np.int32)
    of = np.append(np.ones(1, np.int32), size)
    wide = lambda x: of[np.maximum(x - (first - 1), 0)]
    n = wide(seq)
    place = np.cumsum(n, dtype=np.int64)
    out = np.empty(int(place[-1]) if len(place) else 0, np.int32)
    place -= n
    while len(seq):
        done = seq < first
        out[place[done]] = seq[done]
        more = ~done
        pair, place = rules[seq[more] - first], place[more]
        left, right = pair[:, 0], pair[:, 1]
        seq, place = np.concatenate([left, right]), np.concatenate([place, place + wide(left)])
    return out


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed as four planes of bytes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: magic; the numbers of documents and blocks, the first new symbol, and how long three compressed parts are:
    documents (doc_ids, which of them are known, ids of each), rules, expansion lengths; then for each block of the
    remaining symbols the ids before it and where it ends; then the three parts and the blocks. All little-endian."""
    first, rules, seq = grammar(ids)
    size = lengths(first, rules)
    docs = zlib.compress(b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), counts.astype("<u8"), known.astype("u1"))), 1)
    parts = [docs, planes(rules.ravel()), planes(size)]
    n = np.ones(len(seq), np.int64)
    made = seq >= first
    n[made] = size[seq[made] - first]
    before = (np.cumsum(n) - n)[::BLOCK]
    blocks = [planes(seq[i : i + BLOCK]) for i in range(0, len(seq), BLOCK)]
    ends = np.cumsum([len(b) for b in blocks], dtype=np.int64)
    head = struct.pack("<6Q", len(doc_ids), len(blocks), first, *map(len, parts))
    return b"".join([MAGIC, head, before.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), *parts, *blocks])


class Shard:
    """A shard read back; `inflated` counts the blocks that were decompressed."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        self.n, blocks, self.first, *sizes = struct.unpack_from("<6Q", blob, 4)
        self.before = np.frombuffer(blob, "<u8", blocks, 52).astype(np.int64)
        self.ends = np.frombuffer(blob, "<u8", blocks, 52 + 8 * blocks).astype(np.int64)
        at = 52 + 16 * blocks
        self._docs, rules, size = (blob[a : a + n] for a, n in zip(at + np.cumsum([0, *sizes[:2]]), sizes, strict=True))
        self._blob, self._at, self.inflated = blob, at + sum(sizes), 0
        self.rules, self.size = from_planes(rules).reshape(-1, 2).astype(np.int64), from_planes(size).astype(np.int64)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, which of them are known, and ids of each document."""
        body, n = zlib.decompress(self._docs), self.n
        return np.frombuffer(body, "<i8", n), np.frombuffer(body, "u1", n, 16 * n).astype(bool), np.frombuffer(body, "<u8", n, 8 * n).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on, from the blocks that hold them alone."""
        if n <= 0:
            return np.zeros(0, np.int32)
        a, b = np.searchsorted(self.before, start, side="right") - 1, np.searchsorted(self.before, start + n - 1, side="right") - 1
        seq = []
        for i in range(int(a), int(b) + 1):
            seq.append(from_planes(self._blob[self._at + (int(self.ends[i - 1]) if i else 0) : self._at + int(self.ends[i])]))
            self.inflated += 1
        lead = start - int(self.before[a])
        return expand(self.first, self.rules, self.size, np.concatenate(seq))[lead : lead + n]


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Write the ids of all texts, each with the end id after it, as shards in ascending order of doc_id (null first; rows
    that repeat one in the order of their texts' hashes). A row of the Parquet table at path is a shard: part, number in
    it, its ids' number, its bytes."""
    with open(tokenizer) as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(definition.value), TaskContext.get().partitionId()
        held: list[tuple] = []
        size, number = 0, 0
        close = np.array([end], "<u4").tobytes()

        def shard() -> pa.RecordBatch:
            counts = np.array([len(h[1]) // 4 for h in held])
            ids = np.frombuffer(b"".join(h[1] for h in held), "<u4")
            blob = pack(np.array([h[0] or 0 for h in held]), np.array([h[0] is not None for h in held]), counts, ids)
            held.clear()
            return pa.record_batch({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "ids": pa.array([len(ids)], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, ids in zip(doc_ids, encoder.encode_all(t or "" for t in texts), strict=True):
                held.append((doc_id, ids + close))
                size += len(held[-1][1]) // 4
                if size >= SHARD:
                    yield shard()
                    size, number = 0, number + 1
        if held:
            yield shard()

    # The hash deals rows that repeat a doc_id to several ranges.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.select("doc_id", "text").mapInArrow(run, "part int, number int, ids long, blob binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards at path. start: ids of all documents before it,
    by sums over shards within parts and over parts; the parts are as many as the writer had tasks."""
    shards = spark.read.schema("part int, number int, ids long, blob binary").parquet(path)
    parts = shards.groupBy("part").agg(F.sum("ids").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("part_start"))
    small = shards.select("part", "number", "ids")
    small = small.withColumn("shard_start", F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")).drop("ids")
    starts = small.join(parts, "part").select("part", "number", (F.col("part_start") + F.col("shard_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(blob)
                doc_ids, known, counts = shard.documents()
                ends = np.cumsum(counts)
                data = memoryview(shard.ids(0, int(ends[-1])).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "start": pa.array(start + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64()),
                })

    placed = shards.join(starts, ["part", "number"]).select("start", "blob")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """Write docs in the file format, into the shared folder unless a path is given, and read the files back.

    A null text is empty and has the end id alone; rows that repeat a doc_id follow each other; extra columns are left
    out; an empty table gives no shard and no row.
    """
    path = path or new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
