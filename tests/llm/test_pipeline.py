"""The pipeline: each stage on its own input against an independent expectation, and odd tables."""

import hashlib
from fractions import Fraction

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from terrafold.llm import bpe, langid, quality
from terrafold.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, its string, row string, size string"


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = bpe.Merges(f.read()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave on the smallest tables."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        got = spark.read.parquet(str(folder / name))
        out.append((docs, got))
        docs = got
    return out


def shingle_sets(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_filters_keep_whole_rows(spark, stages):
    for (docs, got), keep in zip(stages[:2], ("language", "quality"), strict=True):
        assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
        if keep == "language":
            model = langid.fit(docs)
            langs, sure = zip(*[(x[0][0], x[1][0]) for t in (r.text for r in docs.collect()) for x in [model.predict(langid.ngrams(t)[None])] if langid.has_letter(t)], strict=True)
            assert got.count() == sum(s >= langid.LEAST_SCORE for s in sure) and set(langs) <= {r.lang for r in docs.collect()}
        else:
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert got.count() == sum(model.tails([r.text])[0, -1] >= quality.LEAST for r in docs.collect())
        assert got.count() > 0.5 * docs.count()


def test_one_of_each_class_of_near_copies_stays(stages):
    docs, got = stages[2]
    sets = sorted((r.doc_id, shingle_sets(r.text, 5)) for r in docs.collect())
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and len(s & u) >= Fraction(4, 5) * len(s | u):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(d) for d, _ in sets})


def test_the_mix_is_that_of_the_sql(stages):
    docs, got = stages[3]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, taken FROM ({ORACLE_SQL['op7_mixing']}) WHERE taken > 0").fetchall()}
    taken = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").encode().split())
        assert text[r.doc_id].startswith(r.text) or r.text == text[r.doc_id]
    assert taken == want


def test_tokens_are_those_of_the_library(stages, reference):
    docs, got = stages[4]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()), ids))
    rows = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_odd_tables(spark, tmp_path):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    odd = [(None, base[0][1], "en", None, None), (None, None, None, None, None), (base[1][0], base[1][1], None, "s", 1), (base[1][0], base[1][1], None, "s", 1), (900, "", "en", "s", 0), (901, " \t\n", None, "s", 3), (902, "1234 %%%", "en", None, 8), (base[2][0], base[3][1], "en", "s", 1), (903, " ".join(base[4][1] for _ in range(300)), base[4][2], "s", 1)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows, own in (("odd", base + odd, labels), ("unlabelled", base + odd, labels.limit(0)), ("empty", [], labels)):
        folder = str(tmp_path / name)
        spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
        own.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        out = got.collect()
        assert (len(out) > 0) == bool(rows) and all(r.n_tokens == len(r.ids) > 0 for r in out) and {r.doc_id for r in out} <= {r[0] for r in rows}
        assert not {900, 901, 902} & {r.doc_id for r in out}
