"""Operator 11: source divergence audit.

Terms are counted by language and source inside tasks, so what is shuffled is partial counts. For the terms by which a
source stands out, the terms of a group fall into buckets of like counts; the highest probability of a bucket's counts and
the lowest probability that the language gives to one of its terms bound how far any of its terms can stand out. Buckets
are taken best first until they hold enough terms, which gives a kth value; of the others only those are evaluated whose
bound isn't strictly below it. Distances between sources come from postings: what a pair would differ in if it shared no
term follows from each source's own counts, and the postings of a term correct that for the sources which share it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleared, matches, tidied, written
from .similarity import asked_for

#: What is between terms; A-Z are lower-cased before. The bytes of a character beyond ASCII are all above 0x7F.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = rb"[\x00-\x40\x5B-\x60\x7B-\x7F]"
#: A language keeps terms in so many documents at least.
LEAST_DOCS = 30
#: Added to each count; probabilities are in units of 1 / SCALE.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Terms listed for a group.
TOP = 50
#: Terms of groups that a task counts before it hands them on, at about 200 bytes each.
HELD = 1_000_000
#: Leading bits by which counts are alike.
LIKE = 6
#: Sources are paired in blocks of so many, and so many pairs of blocks are summed at once.
BLOCK, CELLS = 256, 64
_DOC = 1 << 40
_find, _gap = re.compile(TERM).findall, re.compile(BETWEEN).search


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in part of the rows; a null term counts the
    documents of a group, with or without terms. A task holds HELD terms and those of one document at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes | None, int]] = {}
        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                own = groups.setdefault((lang or "", source or ""), {})
                before, counted = len(own), Counter()
                for part in matches((text.as_py() or b"").lower(), _find, _gap):
                    counted.update(part)
                get = own.get
                for t, n in counted.items():
                    own[t] = get(t, 0) + n + _DOC
                own[None] = get(None, 0) + _DOC
                held += len(own) - before
                if held > HELD:
                    yield from out(groups)
                    groups, held = {}, 0
        yield from out(groups)

    def out(groups: dict[tuple[str, str], dict[bytes | None, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in groups.items():
            packed = np.fromiter(own.values(), np.int64, len(own))
            terms = pa.array(list(own), pa.binary()).cast(pa.string())
            same = lambda x, k=len(own): pa.DictionaryArray.from_arrays(pa.array(np.zeros(k, np.int32)), pa.array([x], pa.string())).cast(pa.string())
            yield pa.record_batch({"lang": same(lang), "source": same(source), "term": terms, "n": pa.array(packed & (_DOC - 1)), "docs": pa.array(packed >> 40)})

    rows = docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(tidied(run), "lang string, source string, term string, n long, docs long")


def probability(n: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * terms)), exactly; 0 without terms."""
    exact = lambda c: c.cast("decimal(18,0)")
    above, below = exact(F.lit(scale)) * exact(n + smoothing), exact(total + smoothing * terms)
    return F.when(terms > 0, 1 + F.call_function("div", above, F.when(below > 0, below))).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, least_docs: int, smoothing: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, place, p0, terms) and postings (lang, source, place, term, n, p, p0, q): p is what the group
    gives the term, q what its language gives, p0 what the group gives a term that it hasn't. The kept terms are written
    before they are joined, so Spark knows their size: few are broadcast, many are joined by a shuffle."""
    made: list[str] = []
    partial = written(partial_counts(docs), "terms", made)
    total = partial.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = written(total.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms", made)
    # Most counts are of terms that aren't kept; all but a few of these end before the join's shuffle.
    key = F.xxhash64("lang", "term")
    near = asked_for(partial.where("term IS NOT NULL"), key, kept.select(key.alias("key")))
    found = written(near.join(kept, ["lang", "term"]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.first("in_lang").alias("in_lang")), "postings", made)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("of_lang"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    none = lambda *names: {c: F.coalesce(c, F.lit(0)).cast("long") for c in names}
    groups = partial.where("term IS NULL").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns(none("of_group", "terms", "of_lang"))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = written(groups.withColumn("p0", probability(F.lit(0), F.col("of_group"), F.col("terms"), smoothing, scale)), "groups")
    p = probability(F.col("n"), F.col("of_group"), F.col("terms"), smoothing, scale)
    q = probability(F.col("in_lang"), F.col("of_lang"), F.col("terms"), smoothing, scale)
    postings = found.join(groups, ["lang", "source"]).select("lang", "source", "place", "term", "n", p.alias("p"), "p0", q.alias("q"))
    postings = written(postings, "placed-postings")
    cleared(docs.sparkSession, made)
    return groups.select("lang", "source", "place", "p0", "terms"), postings


def standing_out(postings: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank: the top terms of each group by p - q, where that is above 0."""
    group = ["lang", "source"]
    shift = F.greatest(F.lit(0), F.length(F.bin("n")) - LIKE).alias("shift")
    rows = postings.withColumn("shift", shift).withColumn("like", F.call_function("shiftright", F.col("n"), F.col("shift")))
    # A group has 2 ** (LIKE - 1) buckets for each bit of a count and no more, so the windows over them are small.
    buckets = rows.groupBy(*group, "shift", "like").agg((F.max("p") - F.min("q")).alias("bound"), F.count_if(F.col("p") > F.col("q")).alias("size"))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "shift", "like")
    buckets = written(buckets.withColumn("before", F.sum("size").over(best) - F.col("size")), "buckets")

    def evaluated(chosen: DataFrame) -> DataFrame:
        value = rows.join(chosen.select(*group, "shift", "like"), [*group, "shift", "like"]).withColumn("value", F.col("p") - F.col("q"))
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "term"))
        return value.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top).select(*group, F.col("term").alias("item"), "value", "rank")

    first = evaluated(buckets.where(F.col("before") < top))
    kth = first.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    left = buckets.join(kth, group, "left").where(F.col("bound") >= F.coalesce("kth", F.lit(1)))
    return evaluated(left)


def shared_terms(postings: DataFrame) -> DataFrame:
    """lang, a, b, value for places a < b: what the terms that both sources have change in their distance. A term's row has
    one entry a source; tasks sum pairs of blocks of sources and hand on what they hold beyond CELLS of these."""
    rows = postings.groupBy("lang", "term").agg(F.collect_list("place").alias("place"), F.collect_list("p").alias("p"), F.collect_list("p0").alias("p0")).where(F.size("place") > 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for lang, place, p, p0 in zip(batch["lang"], batch["place"], batch["p"], batch["p0"], strict=True):
                order = np.argsort(place)
                place, p, p0 = np.asarray(place)[order], np.asarray(p)[order], np.asarray(p0)[order]
                edge = np.flatnonzero(np.diff(place // BLOCK)) + 1
                parts = list(zip(np.split(place, edge), np.split(p, edge), np.split(p0, edge), strict=True))
                for i, (a, pa_, a0) in enumerate(parts):
                    for b, pb, b0 in parts[i:]:
                        change = np.abs(pa_[:, None] - pb) - np.abs(pa_[:, None] - b0) - np.abs(a0[:, None] - pb) + np.abs(a0[:, None] - b0)
                        key = lang, int(a[0] // BLOCK), int(b[0] // BLOCK)
                        if key not in cells:
                            if len(cells) == CELLS:
                                yield from out(cells)
                                cells = {}
                            cells[key] = np.zeros((BLOCK, BLOCK), np.int64)
                        cells[key][np.ix_(a % BLOCK, b % BLOCK)] += change
        yield from out(cells)

    def out(cells: dict[tuple[str, int, int], np.ndarray]) -> Iterator[pd.DataFrame]:
        for (lang, i, j), sums in cells.items():
            a, b = np.nonzero(np.triu(sums, 1) if i == j else sums)
            yield pd.DataFrame({"lang": lang, "a": a + i * BLOCK, "b": b + j * BLOCK, "value": sums[a, b]})

    return rows.drop("term").mapInPandas(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: for each source all others of its language by the sum of |p - q| over kept terms.

    Without shared terms, a pair differs by |p0 - q0| in each term that neither has and by |p - q0| in each term of one
    alone. The sum of |p - q0| over a source's terms comes from running sums over its distinct probabilities.
    """
    own, other = groups.withColumnRenamed("source", "item"), groups.select("lang", F.col("place").alias("b"), F.col("p0").alias("q0"))
    pairs = own.withColumnRenamed("place", "a").join(other, "lang").where("a <> b")
    base = pairs.select("lang", "a", "b", (F.col("terms") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    spread = postings.groupBy("lang", F.col("place").alias("a"), "p0", "p").agg(F.count("*").alias("k")).select("lang", "a", F.lit(None).cast("int").alias("b"), "p0", "p", "k")
    marks = pairs.select("lang", "a", "b", "p0", F.col("q0").alias("p"), F.lit(0).cast("long").alias("k"))
    below, every = Window.partitionBy("lang", "a").orderBy("p"), Window.partitionBy("lang", "a")
    weight = F.col("k") * F.col("p")
    sums = spread.unionByName(marks).withColumns({"k_lo": F.sum("k").over(below), "s_lo": F.sum(weight).over(below), "k_all": F.sum("k").over(every), "s_all": F.sum(weight).over(every)})
    x = F.col("p")
    apart = x * F.col("k_lo") - F.col("s_lo") + (F.col("s_all") - F.col("s_lo")) - x * (F.col("k_all") - F.col("k_lo")) - F.col("k_all") * F.abs(F.col("p0") - x)
    alone = sums.where("b IS NOT NULL").select("lang", "a", "b", apart.alias("value"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    shared = shared_terms(postings)
    parts = base.unionByName(alone).unionByName(turned(alone)).unionByName(shared).unionByName(turned(shared))
    value = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = lambda place, name: groups.select("lang", F.col("place").alias(place), F.col("source").alias(name))
    out = value.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, smoothing: int = SMOOTHING, scale: int = SCALE) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank.

    A null text, lang or source counts as ''. Every (lang, source) that occurs is a group, also without terms; a language
    without kept terms has pairs of value 0 and no terms. Equal values are ordered by item. Repeated rows count as often
    as they occur, extra columns are left out, an empty table gives an empty result. Texts are read whole, in parts.
    """
    groups, postings = counts(docs, least_docs, smoothing, scale)
    names = ["lang", "source", "part", "item", "value", "rank"]
    pair = distances(groups, postings).withColumn("part", F.lit("pair")).select(*names)
    return pair.unionByName(standing_out(postings, top).withColumn("part", F.lit("term")).select(*names))
