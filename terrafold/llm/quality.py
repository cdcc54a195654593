"""Operator 3: a quality classifier by ordinal cumulative-link regression.

One set of weights over hashed text features is shared by all grades; ordered thresholds give each grade its
probability, hence the expected grade and the probability of a grade or better.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hashed, mixed, release, small_batches
from .linear import Rows, ordinal, sigmoid

#: Features by block: words without their case and marks, their last letters, their shapes; a few of the document; and
#: which words and beginnings of words a document has at all, however long it is.
WORDS, ENDS, SHAPES, WHOLE, PRESENT = 1 << 16, 1 << 12, 1 << 12, 64, 1 << 18
COUNTED = WORDS + ENDS + SHAPES + WHOLE
WIDTH = COUNTED + PRESENT
#: Beginnings of so many bytes.
BEGINNINGS = (4, 5)
#: Presence counts for the model where the sample's documents of one grade have it so many standard errors more often
#: than those of the better grades.
SURE = 5.0
#: The fit uses about so many labelled documents, chosen by a hash of doc_id.
ROWS = 8000
#: Labels of documents whose crc32(doc_id as text) leaves this remainder are never learned from, so they test the model.
FOLDS, HELD_OUT = 5, 4
GRADES = 3
#: The value of what is present.
PRESENCE = 0.25
#: A feature gets a weight if so many of the sampled documents have it.
LEAST_DOCUMENTS = 5
#: A document is kept when the probability of the best grade is at least this. On a fold of labelled rows that the fit did
#: not see, 0.7 caught more toxic documents, but where few labels are given (sf0.1) it lost 2 % of clean ones.
LEAST = 0.6
#: A text is read in parts of about so many characters.
PART = 1 << 20

_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def grade(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for good quality that is toxic, 2 for good quality that is not; null if either is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality < 1, 0).when(toxic > 0, 1).otherwise(2).cast("int")


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are kept from learning; a null doc_id has none to keep."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _parts(data: bytes):
    """data in parts that end at white space."""
    at = 0
    while at < len(data):
        end = at + PART
        if end < len(data):
            found = data.find(b" ", end)
            end = len(data) if found < 0 else found
        yield data[at:end]
        at = end


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and values of what is counted in a whole text, and columns of what is present in it. In each counted block
    the values are square roots of shares, so the length of a text doesn't matter. Null and empty texts have the features
    of no words."""
    plain, shapes = Counter(), Counter()
    for part in _parts((text or "").encode()):
        plain.update(part.translate(_PLAIN).split())
        shapes.update([x[-4:] for x in part.translate(_SHAPE).split()])
    words, kinds = hashed(list(plain)), hashed(list(shapes))
    ends = Counter()
    for x, times in plain.items():
        ends[x[-3:]] += times
    total, plain_total = shapes.total(), plain.total()
    places = np.concatenate([words % np.uint64(WORDS), WORDS + hashed(list(ends)) % np.uint64(ENDS), WORDS + ENDS + kinds % np.uint64(SHAPES)]).astype(np.int64)
    columns, at = np.unique(places, return_inverse=True)
    found = np.bincount(at, [*plain.values(), *ends.values(), *shapes.values()], minlength=len(columns))
    of = np.where(columns < WORDS + ENDS, max(1, plain_total), max(1, total))
    values = np.sqrt(found / of)
    distinct = int((columns < WORDS).sum())
    most = float(found[columns < WORDS].max(initial=0))
    base = WORDS + ENDS + SHAPES
    whole = [
        base + min(15, int(4 * np.log10(1 + total))),
        base + 16 + min(15, int(16 * distinct / max(1, plain_total))),
        base + 32 + min(15, int(16 * most / max(1, plain_total))),
        base + 48 + min(15, int(8 * plain_total / max(1, total))),
    ]
    begun = [k for x in plain if len(x) > BEGINNINGS[0] for k in (x[: BEGINNINGS[0]], x[: BEGINNINGS[1]])]
    seen = np.concatenate([mixed(words), hashed(list(set(begun)))])
    present = COUNTED + np.unique((seen % np.uint64(PRESENT)).astype(np.int64))
    return np.concatenate([columns, whole]).astype(np.int32), np.concatenate([values, np.full(4, 0.25)]).astype(np.float32), present.astype(np.int32)


def telling(present: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """By column, whether its presence tells a grade from the better ones (SURE)."""
    out = np.zeros(WIDTH, bool)
    have = [np.bincount(np.concatenate([p for p, g in zip(present, grades, strict=True) if g == k] or [np.zeros(0, int)]), minlength=WIDTH) for k in range(GRADES)]
    for k in range(GRADES - 1):
        n, n_better = int((grades == k).sum()), int((grades > k).sum())
        if n and n_better:
            a, b = have[k], np.sum(have[k + 1 :], axis=0)
            share = (a + b) / (n + n_better)
            error = np.sqrt(np.maximum(share * (1 - share) * (1 / n + 1 / n_better), 1e-12))
            out |= (a / n - b / n_better > SURE * error) & (a + b >= LEAST_DOCUMENTS)
    return out


class Grader:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """By text, the probabilities of more than each grade but the last."""
        score = np.zeros(len(texts))
        for i, t in enumerate(texts):
            columns, values, present = features(t)
            score[i] = float(self.weights[columns] @ values) + float(self.weights[present].sum()) * PRESENCE
        return sigmoid(score[:, None] - self.thresholds)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Grader | None:
    """A model from the grades of about `rows` labelled documents that are not held out; None where there are none.

    Labels with a null are passed over; of a document with several labels the lowest grade counts, and of rows that repeat
    a doc_id one text, that of the least hash. So the sample is bounded by `rows`: its labels are broadcast, and its
    texts' features are collected.
    """
    graded = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id is not null and grade is not null").where(~held_out(F.col("doc_id")))
    n = graded.select("doc_id").distinct().count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("grade"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = graded.where(draw <= min(1.0, rows / n)).groupBy("doc_id").agg(F.min("grade").alias("grade"))

    @F.pandas_udf("columns binary, values binary, present binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = [features(t) for t in texts]
        return pd.DataFrame({"columns": [c.tobytes() for c, _, _ in got], "values": [v.astype(np.float16).tobytes() for _, v, _ in got], "present": [p.tobytes() for _, _, p in got]})

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    sample = one.select("doc_id", "grade", of("text").alias("x"))
    got = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["x"]["columns"])))
    if not got:
        return None
    columns, values, present = ([np.frombuffer(r["x"][c], kind) for r in got] for c, kind in (("columns", np.int32), ("values", np.float16), ("present", np.int32)))
    return learned(columns, values, present, np.array([r["grade"] for r in got]))


def learned(columns: list[np.ndarray], values: list[np.ndarray], present: list[np.ndarray], grades: np.ndarray) -> Grader:
    """The model of rows' features and grades."""
    often = np.bincount(np.concatenate(columns), minlength=WIDTH) >= min(LEAST_DOCUMENTS, len(columns))
    tells = telling(present, grades)
    x, v = [], []
    for c, of, p in zip(columns, values, present, strict=True):
        p = p[tells[p]]
        x.append(np.concatenate([c[often[c]], p]))
        v.append(np.concatenate([of[often[c]], np.full(len(p), PRESENCE)]))
    return Grader(*ordinal(Rows(x, v), grades, GRADES, WIDTH))


def graded(text: Column, model: Grader | None, spark) -> Column:
    """struct<expected_grade, p_fair, p_good>: the expected grade, the probability of more than the lowest grade and that
    of the best. Without a model all are null."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, p_fair double, p_good double")
    def run(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({c: [None] * len(texts) for c in ("expected_grade", "p_fair", "p_good")}, dtype=float)
        tails = shared.value.tails(texts.tolist())
        release()
        return pd.DataFrame({"expected_grade": tails.sum(1), "p_fair": tails[:, 0], "p_good": tails[:, -1]})

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, expected_grade, p_fair, p_good, keep for every row of docs; labels of held-out documents are not
    learned from. Null and empty texts have the features of no words; repeated rows are graded alike; extra columns are
    left out; an empty table gives an empty one. Without any grade to learn from, all are kept with null probabilities."""
    model = fit(docs, labels)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), graded(F.col("text"), model, docs.sparkSession).alias("got"))
    return got.select("doc_id", "held_out", "got.*", F.coalesce(F.col("got.p_good") >= least, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with its columns, that classify keeps."""
    name = fresh(docs, "graded")
    got = docs.withColumn(name, graded(F.col("text"), fit(docs, labels), docs.sparkSession))
    return got.where(F.coalesce(F.col(f"{name}.p_good") >= least, F.lit(True))).select(*docs.columns)
