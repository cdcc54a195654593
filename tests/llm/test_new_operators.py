"""Operators 11 to 13 against plain Python on small tables, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terrafold.llm import common, divergence, importance, tokencount
from terrafold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank string, score string, word string, block string, side string"


def rows_of(n: int, seed: int) -> list[tuple]:
    """Texts over few words, so that ties abound; nulls in every column, repeated rows, one hot source."""
    rng = random.Random(seed)
    words = ["Aa", "bb", "cC", "éa", "Éa", "x1y", "z", "dd-ee", "naïve", "日本"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
    out = [(i, text(), rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "hot", "b", "c", "d", None])) for i in range(n)]
    out += [(n, None, "en", "b"), (n + 1, "", None, None), (n + 2, " \t", "de", "q"), (n + 3, "-- 12", "de", "r"), (None, "aa bb", "en", "b"), (None, None, None, None)]
    out += [out[0]] * 5 + [(n + 4, "bb " * 30_000 + "zz", "en", "c"), (n + 5, "y" * 50_000, "fr", "b")]
    return [(*r, "clash", 7, "clash", "clash", "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(60, 3), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sql(name: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(ORACLE_SQL[name]).df()


@pytest.mark.parametrize("name", ["op11_divergence", "op12_importance"])
def test_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql(name)
    plain = lambda df: sorted(repr([None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


# 11


def audited(rows: list, least: int, top: int) -> list[tuple]:
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        of = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: of(counts[lang, s]) for s in sources}, of(total)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(1, 50), (3, 2), (20, 1), (10_000, 5)])
def test_audit_equals_plain_python(odd, least, top):
    got = divergence.audit(odd, least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited([tuple(r) for r in odd.collect()], least, top)


def test_audit_in_small_steps(odd, monkeypatch):
    """Many hand-overs, many blocks of sources, few held at once, coarse buckets: the same rows."""
    for name, value in (("HELD", 3), ("BLOCK", 2), ("CELLS", 1), ("LIKE", 1)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(odd, 2, 3).collect())) == audited([tuple(r) for r in odd.collect()], 2, 3)


def test_bounds_spare_terms(spark):
    """Only buckets that can hold one of the best terms are evaluated again."""
    rows = [(1, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400) for _ in range(1 + i // 8)), "en", s) for s in "ab"] + [(2, "wzz " * 5000, "en", "a")]
    docs = spark.createDataFrame([(*r, *["-"] * 2) for r in rows], "doc_id long, text string, lang string, source string, n string, p string")
    assert sorted(map(tuple, divergence.audit(docs, 1, 3).collect())) == audited(rows, 1, 3)


def test_audit_of_nothing(none):
    assert divergence.audit(none).count() == 0


# 12


def resampled(docs: list, target: list, longest: int, buckets: int, least: int, percent: int) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    own = [(r[0], words(r[1])) for r in docs]
    s, t = Counter(b for _, w in own for b in runs(w)), Counter(b for x in target for b in runs(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, w in own:
        f = runs(w)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    drawn = percent * len(able) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in out if r[4] < least]


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("longest, buckets, least, percent", [(1, 10_000, 20, 10), (2, 50, 5, 50), (3, 10_000, 2, 100), (1, 7, 1, 0)])
def test_resampling_equals_plain_python(spark, odd, longest, buckets, least, percent):
    target = spark.createDataFrame([(1, "bb z éa bb", "x"), (2, None, "x"), (3, "aa bb cc", "x"), (3, "unseen words", "x")], "item_id long, text string, doc_id string")
    got = importance.resample(odd, target, longest, buckets, least, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(resampled([tuple(r) for r in odd.collect()], [r["text"] for r in target.collect()], longest, buckets, least, percent))


def test_resampling_in_small_blocks(spark, odd):
    """The numbers of a block are its own: blocks of one document count alike."""
    whole, small = (importance.blocks(odd, odd.limit(0), 2, size).where("counts IS NOT NULL") for size in (1 << 24, 1))
    assert small.select("block").distinct().count() == small.count() == whole.count()
    features = lambda df: Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_features").collect())
    assert features(whole) == features(small)


def test_packed_numbers_come_back():
    rng = random.Random(1)
    for size in (0, 1, 500):
        x = [rng.choice([0, 3, 70_000, 2**31 - 1]) for _ in range(size)]
        values, n = importance.unpacked(importance.packed(importance.np.array(x, importance.np.int64)))
        assert dict(zip(values.tolist(), n.tolist(), strict=True)) == Counter(x)


def test_resampling_of_nothing(spark, odd, none):
    assert importance.resample(none, odd).count() == 0
    got = importance.resample(odd, none, least_words=1, percent=100).collect()
    assert ordered(got) == ordered(resampled([tuple(r) for r in odd.collect()], [], 1, 10_000, 1, 100))


def test_ranks_of_a_third_of_equal_rows(spark):
    df = spark.range(900).selectExpr("IF(id % 3 = 0, 5, id) AS x", "'c' AS tie", "'c' AS part")
    got = common.ranked(df, [F.col("x").desc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 901))
    assert [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)


# 13


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=tokencount.MODEL)


def test_counts_equal_the_library(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect()}
    for frequent in (0, 100, tokencount.FREQUENT):
        got = tokencount.count_tokens(docs, limit=500, frequent=frequent).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
        assert all(r["over_limit"] == (r["n_tokens"] > 500) for r in got)
    assert any(r["over_limit"] for r in got) and not all(r["over_limit"] for r in got)


def test_counts_of_random_texts(model, monkeypatch):
    with open(tokencount.MODEL, "rb") as f:
        counts = tokencount.Counts(f.read())
    assert counts.apart
    rng = random.Random(5)
    for part, remembered in ((1 << 20, 200_000), (7, 3)):
        monkeypatch.setattr(tokencount, "PART", part)
        monkeypatch.setattr(tokencount, "REMEMBERED", remembered)
        texts = ["".join(rng.choice(" \n\t\r▁abé中1<s>\x00 　ﬁ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
        texts += ["", None, " ", "  ", "\n", "▁", "a ", " a", "</s><unk>", "<0x0A>", "x" * 5000, " " * 5000, "\n" * 500]
        frequent = {p: n for p, n in (("", 1), ("a", counts.encoded(["a"])[0]), ("\n", counts.encoded(["\n"])[0]))}
        assert counts.count(texts, frequent) == [len(model.encode(t or "")) for t in texts]


def test_a_model_that_cannot_be_cut(model):
    """Texts are encoded whole where a cut could change them."""
    with open(tokencount.MODEL, "rb") as f:
        counts = tokencount.Counts(f.read())
    counts.apart = False
    assert counts.count(["a b", None, "c\nd"], {}) == [len(model.encode(t)) for t in ("a b", "", "c\nd")]


def test_frequent_pieces_are_the_frequent_ones(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(20_000)]
    docs = spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, len(words), 50)], "text string").repartition(7)
    got = tokencount.frequent_pieces(docs, k=50)
    assert len(got) == 50 and set(got) >= {w for w, _ in Counter(words).most_common(20)}


def test_counts_of_odd_rows(odd, none, model):
    got = tokencount.count_tokens(odd)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in odd.collect()]
    assert ordered(got.collect()) == ordered(want)
    assert tokencount.count_tokens(none).count() == 0
