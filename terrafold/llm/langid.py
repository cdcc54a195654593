"""Operator 8: language identification in two steps: the family, then the language within it.

Both steps are linear support vector machines on hashed letter n-grams: one against the rest for families, one versus one
within a family. A language that isn't named below joins the unnamed ones most like it, a few at a time, so the number of
machines grows with that of languages, and all of them are learned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, small_batches
from .linear import OneVersusOne, OneVersusRest

#: Closely related languages. Fixed values.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
}
WIDTH = 4096
#: The fit uses about so many rows of each language, chosen by a hash of doc_id and text, and about so many in all, but
#: about so many of each at least.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 600, 16_000, 16
#: A family holds so many languages that no one named, at most; each two of them have a machine.
MOST_RELATED = 12
#: A table with more different values of lang holds something else there; that is an error, not a reason to drop any.
MOST_LANGUAGES = 20_000
UNKNOWN = "und"
#: The remainder of crc32(doc_id) by FOLDS that is held out.
FOLDS, HELD_OUT = 4, 2
#: A text is read in parts of so many bytes, so that memory doesn't grow with it.
PART = 1 << 20

#: Bytes as they enter an n-gram: letters, and the bytes of characters beyond ASCII, as they are; all others one blank.
_CODE = np.array([i if chr(i).isalpha() and i < 128 or i >= 128 else 32 for i in range(256)], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Square roots of the shares that hashed 1-, 2- and 3-grams have in a whole text; their squares sum to 1."""
    data = np.frombuffer(f"  {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(WIDTH)
    for at in range(0, len(data), PART):
        b = _CODE[data[max(0, at - 2) : at + PART]]
        skip = 2 if at == 0 else 0
        c = b[2:]
        keep = (c != 32) | (b[1:-1] != 32)
        two = b[1:-1] * np.uint32(31) + c
        three = (b[:-2] * np.uint32(40503) + two * np.uint32(2654435)) >> np.uint32(3)
        for code in (c, 256 + two * np.uint32(7), three):
            counts += np.bincount((code[keep] % np.uint32(WIDTH)).astype(np.int64), minlength=WIDTH)
    total = counts.sum()
    return np.sqrt(counts / total if total else counts).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is not held out, and not learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def family_of(x: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]], most: int = MOST_RELATED) -> dict[str, str]:
    """The family of each language. The first language by code point without one takes the most - 1 others without one whose
    mean features are most like its own, and so on."""
    of = {a: family for family, langs in families.items() for a in langs}
    left = sorted(set(lang.tolist()).difference(of))
    mean = {a: x[lang == a].mean(0) for a in left}
    while left:
        first = mean[left[0]]
        near = sorted(left[1:], key=lambda a: (float(((mean[a] - first) ** 2).sum()), a))[: most - 1]
        of |= dict.fromkeys([left[0], *near], f"like {left[0]}")
        left = [a for a in left if a not in of]
    return of


class Hierarchy:
    """Families first, then the languages of the predicted family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]] = FAMILIES):
        of = family_of(x, lang, families)
        family = np.array([of[a] for a in lang.tolist()], dtype=object)
        self.families = OneVersusRest(x, family)
        self.within = [OneVersusOne(x[family == f], lang[family == f]) for f in self.families.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.predict(x)
        out, score = [""] * len(x), np.zeros(len(x))
        for f, model in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            best, own = model.predict(x[rows])
            score[rows] = sure[rows] * own
            for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                out[r] = model.classes[b]
        return out, score


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Hierarchy | None:
    """A model from text and lang of the rows that are not held out; None where there are none.

    The sample has about rows_per_language rows of each language and about ROWS in all, but LEAST_ROWS of each language, so
    what reaches the driver is bounded by that and the number of languages, whatever the table holds. Rows without text, lang, doc_id or any letter are not learned from; repeated rows count once.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in sizes.limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    rows = max(LEAST_ROWS, min(rows_per_language, ROWS // len(counts)))
    share = F.broadcast(known.sparkSession.createDataFrame([(k, min(1.0, rows / n)) for k, n in sorted(counts.items())], "lang string, share double"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([ngrams(t).astype(np.float16).tobytes() if has_letter(t) else None for t in texts], dtype=object)

    sample = known.join(share, "lang").where(draw <= F.col("share")).dropDuplicates(["doc_id", "lang", "h"]).select("doc_id", "lang", features("text").alias("x"))
    got = sorted((r for r in sample.collect() if r["x"] is not None), key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return Hierarchy(x, np.array([r["lang"] for r in got], dtype=object), families)


def predicted(text: Column, model: Hierarchy | None, spark) -> Column:
    """struct<lang_pred, score>. A null text, one without a letter, and every text where nothing could be learned are
    `und` with score 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = [has_letter(t) and shared.value is not None for t in texts]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = np.flatnonzero(known)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            got, sure = shared.value.predict(np.stack([ngrams(texts.iloc[i]) for i in part]))
            scores[part] = sure
            for i, lang in zip(part.tolist(), got, strict=True):
                langs[i] = lang
        release()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(text)


def identify(docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; predictions see the text alone. Repeated rows are predicted
    alike, extra columns are left out, an empty table gives an empty one."""
    model = model or fit(docs)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model, docs.sparkSession).alias("got"))
    return got.select("doc_id", "held_out", "got.lang_pred", "got.score")


#: A document whose language is less sure than this is rejected. Of 2,499 held-out rows at sf0.1 two score less, of one and of
#: five words; 14 texts in other languages, of random letters or hexadecimal scored 0.26 to 0.38.
LEAST_SCORE = 0.45


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with its columns, whose language is known and sure enough."""
    name = fresh(docs, "identified")
    got = docs.withColumn(name, predicted(F.col("text"), fit(docs), docs.sparkSession))
    return got.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*docs.columns)
