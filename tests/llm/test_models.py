"""Operators 3 and 8: the fits against plain arithmetic, bounded samples, held-out labels, odd rows."""

import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import langid, quality
from terrafold.llm.linear import OneVersusOne, OneVersusRest, Rows, ordinal, ordinal_loss, svm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, "the cat sat on the mat", "en", "a", 1), (2, None, "en", "a", 1), (3, "", None, None, None), (4, "the cat", "en", "a", 1), (5, LONG, "en", "b", 1), (None, "no id", "en", "a", 1), (4, "the cat", "en", "a", 1), (7, " \t", "xx", None, 1)]


def plain_loss(columns, values, grade, w, base, gaps, ridge):
    """The likelihood term by term."""
    theta = [base[0]]
    for g in gaps:
        theta.append(base[0] + sum(math.exp(h) for h in gaps[: len(theta)]))
    total = 0.0
    for c, v, g in zip(columns, values, grade, strict=True):
        score = sum(w[i] * x for i, x in zip(c, v, strict=True))
        tails = [1.0, *(1 / (1 + math.exp(-(score - t))) for t in theta), 0.0]
        total -= math.log(tails[g] - tails[g + 1])
    return total / len(grade) + ridge / 2 * sum(x * x for x in w)


def test_ordinal_loss_and_gradient_equal_plain_arithmetic():
    rng = np.random.default_rng(5)
    columns = [rng.choice(6, rng.integers(1, 5), replace=False) for _ in range(30)]
    values = [rng.normal(size=len(c)) for c in columns]
    grade, w, base, gaps = rng.integers(0, 4, 30), rng.normal(size=6), np.array([-0.3]), np.array([0.2, -0.4])
    loss = lambda a, b, c: plain_loss(columns, values, grade, a, b, c, 0.01)
    got, grads = ordinal_loss(Rows(columns, values), grade, w, base, gaps, 0.01)
    assert got == pytest.approx(loss(w, base, gaps), rel=1e-5)
    parts = [w, base, gaps]
    for p, part in enumerate(parts):
        for i in range(len(part)):
            up, down = ([x.copy() for x in parts] for _ in range(2))
            up[p][i] += 1e-5
            down[p][i] -= 1e-5
            assert grads[p][i] == pytest.approx((loss(*up) - loss(*down)) / 2e-5, abs=1e-5)


def test_ordinal_fit_is_near_the_best_of_a_grid():
    x = np.repeat([-1.0, 0.0, 1.0], 40)
    rng = np.random.default_rng(1)
    grade = np.clip(np.round(x + rng.normal(scale=0.6, size=len(x)) + 1), 0, 2).astype(int)
    rows = Rows([np.array([0])] * len(x), [np.array([v]) for v in x])
    w, theta = ordinal(rows, grade, 3, 1, steps=400, rate=0.1)
    best = min(ordinal_loss(rows, grade, np.array([a]), np.array([b]), np.array([c]), 1e-5)[0] for a in np.arange(0, 6, 0.25) for b in np.arange(-4, 2, 0.25) for c in np.arange(-1, 2, 0.25))
    assert ordinal_loss(rows, grade, w, theta[:1], np.log(np.diff(theta)), 1e-5)[0] <= best + 1e-3 and np.all(np.diff(theta) > 0)


def test_graded_rows_equal_plain_arithmetic(spark):
    texts = ["alpha beta " * 3, "gamma delta", None, "", LONG]
    model = quality.Grader(np.random.default_rng(2).normal(size=quality.WIDTH), np.array([-0.5, 0.7]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.g for r in frame.select("doc_id", quality.graded(F.col("text"), model, spark).alias("g")).collect()}
    for i, t in enumerate(texts):
        columns, values, present = quality.features(t)
        score = sum(float(model.weights[c]) * float(v) for c, v in zip(columns, values, strict=True)) + sum(float(model.weights[c]) for c in present) * quality.PRESENCE
        tails = [1 / (1 + math.exp(-max(-35, min(35, score - b)))) for b in model.thresholds]
        assert (got[i].p_fair, got[i].p_good, got[i].expected_grade) == pytest.approx((*tails, sum(tails)), abs=1e-3)


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    turned = labels.withColumns({"quality": F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
    assert labels.where(out).count() > 0 and quality.fit(docs, labels.where(out)) is None


def test_samples_are_bounded_by_documents(spark, monkeypatch):
    rows = [(1, "one text here", "en", "a", 1)] * 500 + [(2, f"text number {i}", "en", "a", 1) for i in range(500)] + [(3, "un texte ici", "fr", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    seen = {}
    learned = quality.learned
    monkeypatch.setattr(quality, "learned", lambda *a: seen.update(n=len(a[0])) or learned(*a))
    assert quality.fit(docs, labels) is not None and seen["n"] <= 3
    init = langid.Hierarchy.__init__
    monkeypatch.setattr(langid.Hierarchy, "__init__", lambda self, x, lang, families: seen.update(x=len(x), langs=set(lang.tolist())) or init(self, x, lang, families))
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 50)
    langid.fit(docs, 50)
    assert seen["x"] <= 100
    assert seen["langs"] == {"en", "fr"}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.identify(docs)


def test_pairs_of_classes_vote():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 1), (1, 0), (1, 1))]).astype(np.float32)
    model = OneVersusOne(x, np.repeat(["a", "b", "c"], 20).astype(object))
    best, sure = model.predict(x)
    assert [model.classes[b] for b in best] == ["a"] * 20 + ["b"] * 20 + ["c"] * 20 and ((sure > 0.5) & (sure <= 1)).all()


def test_one_class_against_the_rest():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 2), (2, 0), (-2, -2))]).astype(np.float32)
    y = np.repeat(["a", "b", "c"], 20).astype(object)
    model = OneVersusRest(x, y)
    best, sure = model.predict(x)
    assert [model.classes[b] for b in best] == y.tolist() and ((sure > 0.5) & (sure <= 1)).all()
    for i, a in enumerate("abc"):
        alone = svm(x, np.where(y == a, 1, -1).astype(np.float32))
        assert np.allclose(np.append(model.w[:, i], model.b[i]), alone, atol=1e-3)
    only = OneVersusRest(x[:20], y[:20])
    assert only.predict(x)[0].tolist() == [0] * 60 and model.predict(x[:0])[0].tolist() == []


def invented(languages: int, rows: int) -> list[tuple]:
    """Rows of languages with words of their own over letters of their own preference."""
    out = []
    for k in range(languages):
        rng = random.Random(k)
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzéèüñçøåß", 9)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(30)]
        out += [(k * rows + i, " ".join(rng.choices(words, k=40)), f"x{k:03d}", "a", 1) for i in range(rows)]
    return out


def test_each_of_two_hundred_languages_can_be_predicted(spark):
    docs = spark.createDataFrame(invented(200, 24), SCHEMA)
    model = langid.fit(docs)
    assert len(model.families.classes) == 17 and max(len(m.classes) for m in model.within) == langid.MOST_RELATED
    assert sum(len(m.w) for m in model.within) < 200 * langid.MOST_RELATED
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got if r.lang_pred == r.lang} == {f"x{k:03d}" for k in range(200)}
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_prediction_in_two_steps(spark):
    """Family, then votes of pairs within it, by loops over the model's weights."""
    rows = invented(30, 16) + [(10_000 + 100 * ord(lang[0]) + i, t, lang, "a", 1) for lang, words in (("en", "the and with of"), ("de", "der und mit von"), ("fr", "les et avec des"), ("it", "gli con per che")) for i, t in enumerate([" ".join(random.Random(f"{lang}{j}").choices(words.split(), k=20)) for j in range(16)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    of = langid.family_of(np.eye(30, dtype=np.float32), np.array([f"x{k:03d}" for k in range(30)], dtype=object), langid.FAMILIES)
    assert of["de"] == of["en"] == "germanic" and of["fr"] == "romance" and len({of[f"x{k:03d}"] for k in range(30)}) == 3
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in rows:
        x = langid.ngrams(r[1]).astype(float)
        margins = [float(x @ model.families.w[:, f] + model.families.b[f]) for f in range(len(model.families.classes))]
        f = max(range(len(margins)), key=margins.__getitem__)
        own = model.within[f]
        votes, least = [0] * len(own.classes), [8.0] * len(own.classes)
        for (i, j), w in zip(own.pairs, own.w, strict=True):
            m = float(x @ w[:-1] + w[-1])
            votes[i if m > 0 else j] += 1
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(votes)), key=lambda k: votes[k] + (np.tanh(least[k]) + 1) / 4)
        lang, score = got[r[0]]
        assert lang == own.classes[best]
        assert abs(score - 1 / (1 + np.exp(-4 * margins[f])) / (1 + np.exp(-4 * least[best]))) < 1e-3


def test_equal_languages_tie(spark):
    """Of languages with the same texts, one is predicted, the same for equal texts, and without much confidence."""
    docs = spark.createDataFrame([(k * 40 + i, f"same words here number {'abcdefgh'[i % 8]}", lang, "a", 1) for k, lang in enumerate(("en", "de", "xx")) for i in range(40)], SCHEMA)
    got = langid.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by_text.values()) and all(0 <= r.score < 0.7 for r in got)


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], SCHEMA + ", graded string, identified string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(odd, labels).collect()
    assert 0 <= len(kept) <= len(ODD) and all(r.graded == "clash" for r in kept)
    assert sorted(map(repr, map(tuple, quality.keep_good(odd, labels.limit(0)).collect()))) == sorted(map(repr, map(tuple, odd.collect())))
    sure = langid.keep_identified(odd).collect()
    assert {r.doc_id for r in sure} <= {1, 4, 5, None} and all(r.identified == "clash" for r in sure)
    assert langid.keep_identified(odd.limit(0)).count() == 0 and quality.keep_good(odd.limit(0), labels).count() == 0
    assert langid.keep_identified(odd.withColumn("lang", F.lit(None).cast("string"))).count() == 0
