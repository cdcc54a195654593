"""Operator 13: token counts by a two-tier lookup on the map side.

A text is cut where no token can reach across. The lengths of the most frequent pieces come from a table that is
broadcast; its size is bounded. Pieces that it misses are encoded by the library and remembered by the worker. No piece is
shuffled: the frequent ones are found from a bounded summary of each task, merged in steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Pieces in the broadcast table, and in the summary of a task.
FREQUENT = 32_768
#: Longer pieces are neither in the table nor remembered, so both are bounded in bytes.
LONGEST = 40
#: Summaries merged at once; two steps before the last one do for the square of it times as many tasks.
MERGED = 128
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Texts are read in parts of so many characters.
PART = 1 << 20
LIMIT = 4096
_SPACE = "▁"
#: Runs of spaces with what follows, or a line end with what follows; _edge: where one of these begins.
_pieces, _edge = re.compile(r" +[^ \n]*|\n[^ \n]*").findall, re.compile(r"(?<! )[ \n]").search


def parts(text: str) -> Iterator[str]:
    """A text with the space that the model puts before it, in parts that begin with a space or a line end."""
    body, at = " " + text.replace(_SPACE, " "), 0
    while len(body) - at > PART:
        edge = _edge(body, at + PART)
        if not edge:
            break
        yield body[at : edge.start()]
        at = edge.start()
    yield body[at:] if at else body


def pieces_of(part: str) -> list[str]:
    """The pieces of a part without the first space of each; those that begin with a line end have none."""
    spaced = part.replace("\n", " \n")
    if "  " not in spaced:
        return spaced[1:].split(" ")
    return [p[1:] if p[0] == " " else p for p in _pieces(part)]


class Counts:
    """The library's model, and how many tokens it gives for pieces."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  ﬁ é\té  AＡ "
        #: Whether a cut before a space or a line end is right: no token has a space after anything else, none holds a line end,
        #: and the text is taken as it is but for a space before it.
        self.apart = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in vocabulary) and self.model.normalize(probe) == _SPACE + probe.replace(" ", _SPACE)
        self.seen: dict[str, int] = {}

    def encoded(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each piece. A piece without anything is the lone space; before a line end the library's own
        space is one token more."""
        return [1 if not p else len(ids) - (p[0] == "\n") for p, ids in zip(pieces, self.model.encode(pieces, num_threads=1), strict=True)]

    def count(self, texts: list[str | None], frequent: dict[str, int]) -> list[int]:
        """The number of tokens of each whole text; null and the empty text have none."""
        if not self.apart:
            return [len(ids) for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        totals, waiting, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for part in parts(text) if text else ():
                waiting.append((i, pieces_of(part)))
                size += len(part)
                if size >= PART:
                    self.add(waiting, frequent, totals)
                    waiting, size = [], 0
        self.add(waiting, frequent, totals)
        return totals

    def add(self, waiting: list[tuple[int, list[str]]], frequent: dict[str, int], totals: list[int]) -> None:
        """Add the tokens of the pieces of each text to its total; what the table misses is encoded together."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        found = [list(map(frequent.get, own)) for _, own in waiting]
        missed = [[p for p, n in zip(own, lengths, strict=True) if n is None] for (_, own), lengths in zip(waiting, found, strict=True)]
        new = list(set().union(*missed).difference(self.seen))
        self.seen.update(zip(new, self.encoded(new), strict=True))
        get = self.seen.__getitem__
        for (i, _), lengths, rest in zip(waiting, found, missed, strict=True):
            totals[i] += sum(filter(None, lengths)) + sum(map(get, rest))
        for p in new:
            if len(p) > LONGEST:
                del self.seen[p]


_LOADED: dict[int, Counts] = {}


def loaded(model: bytes) -> Counts:
    """One model a Python worker, kept from task to task."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counts(model)
    return _LOADED[key]


def frequent_pieces(docs: DataFrame, text: str = "text", k: int = FREQUENT) -> list[str]:
    """About the k most frequent pieces over all rows, k at most. Each task counts its pieces, forgets the rarest beyond 8 * k
    and gives its k first in one row; rows are merged MERGED at a time. Which pieces come out has no bearing on counts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in parts(t) if t else ():
                    held.update(pieces_of(part))
                if len(held) > 8 * k:
                    held = Counter(dict(held.most_common(4 * k)))
        yield summary(held)

    def summary(held: Counter[str]) -> pa.RecordBatch:
        best = [(p, n) for p, n in held.most_common(2 * k) if len(p) <= LONGEST][:k]
        return pa.record_batch({"pieces": pa.array([[p for p, _ in best]], pa.list_(pa.string())), "n": pa.array([[n for _, n in best]], pa.list_(pa.int64()))})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        held: Counter[str] = Counter()
        for p, n in zip(group["pieces"], group["n"], strict=True):
            held.update(dict(zip(p.tolist(), n.tolist(), strict=True)))
        out = summary(held).to_pandas()
        out.insert(0, "step", int(group["step"].iloc[0]) // MERGED)
        return out

    rows = docs.select(F.col(text).cast("string")).mapInArrow(tidied(summed), "pieces array<string>, n array<long>")
    rows = rows.select(F.floor(F.spark_partition_id() / MERGED).alias("step"), "pieces", "n")
    for last in (False, False, True):
        rows = rows.withColumn("step", F.lit(0).cast("long")) if last else rows
        rows = rows.groupBy("step").applyInPandas(merged, "step long, pieces array<string>, n array<long>")
    found = rows.select("pieces").first()
    return list(found[0]) if found else []


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs, as the library counts the whole text, without added tokens.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, a null doc_id stays null, extra
    columns are left out, an empty table gives an empty one. Texts are read whole, in parts. Two scans, the first for the
    frequent pieces; no shuffle but that of bounded summaries. The model is a file of fixed size; it is broadcast with the
    table of at most `frequent` pieces of LONGEST characters.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        lines = f.read()
    counts = loaded(lines)
    pieces = frequent_pieces(docs, k=frequent) if counts.apart else []
    shared = docs.sparkSession.sparkContext.broadcast((lines, dict(zip(pieces, counts.encoded(pieces), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, table = shared.value
        own = loaded(lines)
        for batch in batches:
            n = own.count(batch.column(1).to_pylist(), table)
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(n, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
