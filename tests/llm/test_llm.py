import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrafold.llm import bpe, fingerprint, langid, mixing, quality, repair, similarity, topk, warc
from terrafold.llm.common import shingles
from terrafold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [(1, "the cat sat on the mat", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "the cat sat on the mat", "en", "a"), (5, LONG, "en", "b"), (6, "one", None, "c"), (7, " \t\n", "en", None), (None, "no id here at all", "en", "a"), (4, "the cat sat on the mat", "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names clash with results."""
    return spark.createDataFrame([(*r, None, "clash", "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# 1


@pytest.fixture(scope="module")
def merges():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Merges(f.read())


@pytest.fixture(scope="module")
def reference(merges):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


def test_bpe_on_random_texts(merges, reference):
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("ab cd'st\n\t  éü漢字🙂1২\x1c\x85\xa0.,!?") for _ in range(rng.randint(0, 60)))
        want = reference.encode_ordinary(text)
        assert merges.encode(text) == want and merges.decode(want) == text.encode()
        first, rest = bpe.chunks_of(text)
        merges.learn([first], rest)
        got = [merges.seen[first][0]] + [merges.seen_spaced[x][0] for x in rest]
        assert ",".join(x for x in got if x) == ",".join(map(str, want))


def test_bpe_of_a_long_piece(merges, reference):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgé") for _ in range(5000))
    assert merges.encode(text) == reference.encode_ordinary(text)


def test_bpe_of_odd_rows(odd, none, reference):
    got = bpe.encode_documents(odd).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.encode_documents(none).count() == 0
    back = bpe.decoded_text(bpe.token_ids(odd.select("text")), "ids").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


# 2


def test_fingerprints(odd, none, docs):
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in fingerprint.compare_documents(docs).collect()}
    ids = sorted(rows, reverse=True)
    for i, d in enumerate(ids):
        text, after = rows[d], rows[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        assert got[d].edited_sha256 == sha((text[: len(text) - half] + after[:half]).encode()) and got[d].n_chars == len(text)
        assert 0 <= got[d].near_next <= 1 and (got[d].near_next == 1 or text != after)
    by_text = {}
    for d, text in rows.items():
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint
    assert fingerprint.compare_documents(odd).count() == len(ROWS) and fingerprint.compare_documents(none).count() == 0


def test_likeness_is_exact():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 50, 3000)]
    b = [np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, 7).astype(np.uint64)]) for x in a]
    near, _ = fingerprint.likeness(a, b)
    want = [2 * len(np.intersect1d(x, y)) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)]
    assert near.tolist() == pytest.approx(want)
    assert fingerprint.likeness(a, a)[0].tolist() == [1.0] * 4


# 3


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, rest = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = quality.classify(d.join(rest.select("doc_id"), "doc_id", "left_semi").union(d.join(known.select("doc_id"), "doc_id", "left_semi")), known).join(rest, "doc_id")
    r = got.agg(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("keep").cast("int"))).alias("clean"), F.avg(F.when(F.col("quality") == 0, F.col("keep").cast("int"))).alias("low"), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.col("keep").cast("int"))).alias("toxic")).first()
    assert r.clean > 0.98 and r.low < 0.1 and r.toxic < 0.2


def test_presence_is_told_from_few_words_in_long_texts():
    clean = ["alpha beta gamma delta " * (5 + i) for i in range(60)]
    toxic = [t + "vexoria " for t in clean]
    rows = [quality.features(t) for t in clean + toxic]
    model = quality.learned(*[list(x) for x in zip(*rows, strict=True)], np.array([2] * 60 + [1] * 60))
    good = model.tails(["alpha beta gamma delta " * 500, "alpha beta gamma delta " * 500 + "vexolt", ""])[:, -1]
    assert good[0] > 0.5 > good[1] and 0 <= good[2] <= 1


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == len(ROWS) and quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("keep and p_good is null").count() == len(ROWS)
    assert quality.keep_good(odd, labels).columns == odd.columns


# 4


def brute(rows, k, least):
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, set(shingles(t, k).tolist())) for d, t in rows]
    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and len(s & u) >= least * len(s | u):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: find(d) for d in up}


@pytest.mark.parametrize(("k", "least"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_join_equals_brute_force(spark, docs, k, least):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    near = [(10_000 + i, " ".join(f"n{rng.randint(0, 10**6)}" if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([*near, (20_000, "a b"), (20_001, "A  B"), (20_002, "a b c")], "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in similarity.classes(frame, k, least).collect()}
    assert got == brute([tuple(r) for r in frame.collect()], k, least)


def test_join_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"n{rng.randint(0, 10**6)}" if rng.random() < 0.012 else w for w in base)) for i in range(40)]
    monkeypatch.setattr(similarity, "CHUNK", 600)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similarity.classes(frame, 3, Fraction(9, 10)).collect()}
    assert got == brute(rows, 3, Fraction(9, 10))


def test_join_of_odd_rows(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.classes(odd, 3, Fraction(9, 10)).collect()}
    assert got[1] == (4, 1) and got[4] == (4, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[6] == (1, 6) and got[7] == (0, 7)
    assert similarity.classes(none).count() == 0
    assert sorted(str(r.doc_id) for r in similarity.keep_one(odd).collect()) == ["1", "2", "3", "5", "6", "7", "None"]


def test_keep_one_of_each_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (5, a), (5, f"{b} end"), (6, a), (6, a), (None, a), (None, c), (None, c), (None, f"{c} end"), (8, c.upper() + " end"), (8, c), (9, " "), (9, " "), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in similarity.keep_one(frame).collect()), key=repr)
    assert got == sorted([(3, b), (5, a), (8, c.upper() + " end"), (9, " "), (9, " "), (None, None)], key=repr)
    got = similarity.keep_one(frame.where("doc_id is null")).collect()
    assert sorted(map(repr, (r.text for r in got))) == sorted(map(repr, (a, c, None)))
    got = similarity.keep_one(spark.createDataFrame([(1, a), (1, b), (1, c), (1, c)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == [a, b, c]
    got = similarity.keep_one(spark.createDataFrame([(2, a), (1, a), (3, b)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, a), (3, b)]


# 5


def test_token_files(odd, none, docs):
    tokenizer = Tokenizer.from_file(repair.TOKENIZER)
    for frame in (docs, odd):
        rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        start, want = 0, []
        for doc_id, text in rows:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted(map(tuple, repair.round_trip(frame).collect()), key=lambda r: r[1])
        assert got == want
    assert repair.round_trip(none).count() == 0


def test_grammar_and_random_access():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, np.int64), np.ones(999, np.int64), np.tile([5, 6, 7], 500), rng.integers(0, 9, 20_000)):
        shard = repair.Shard(repair.pack(np.array([1]), np.array([True]), np.array([len(ids)]), ids))
        assert shard.ids(0, len(ids)).tolist() == ids.tolist()
        for a in (0, len(ids) // 3, max(0, len(ids) - 5)):
            assert shard.ids(a, min(17, len(ids) - a)).tolist() == ids[a : a + 17].tolist()


# 6


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html><title>T&amp;x</title><script>no</script><p>one<br>two</p><!-- c --></html>"), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    responses = warc.responses(pages)
    derived = {(r.page_id, r.record_type): r for r in warc.derive(responses).collect()}
    assert len(derived) == 6 and bytes(derived[1, "conversion"].block) == b"T&x\none\ntwo"
    ids = {r.page_id: r for r in responses.collect()}
    for (page, _), r in derived.items():
        assert r.refers_to == ids[page].record_id and r.source_digest == warc.digest(ids[page].headers.encode() + bytes(ids[page].body)) and r.block_digest == warc.digest(bytes(r.block))
    members = b"".join(bytes(r.member) for r in warc.as_warc(warc.derive(responses)).collect())
    heads = [h for h, _ in warc.records_in(members)]
    assert sorted(h["warc-type"] for h in heads) == ["conversion"] * 3 + ["metadata"] * 3 and all(h["warc-refers-to"] for h in heads)
    file = b"".join(warc.warc_bytes("response", r.record_id, r.target_uri, r.date, "application/http", r.headers.encode() + bytes(r.body), {}) for r in ids.values())
    (tmp_path / "a.warc.gz").write_bytes(file)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(file))
    read = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.body)) for r in read) == sorted(2 * [(r.record_id, bytes(r.body)) for r in ids.values()])


# 7


def test_targets(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 1000), ("1", 90)], "src string, source_size long")
    got = {r.src: r.target for r in mixing.targets(sizes).collect()}
    assert got["0a"] == 30 and got["1"] == 270 and sum(got.values()) == pytest.approx(2100)
    assert got["0b"] / got["0c"] == pytest.approx(2)


def test_mixing(docs, odd, none):
    for frame in (docs, odd):
        got = mixing.mixed(frame).join(frame.select("doc_id", "source").distinct(), "doc_id").where("taken > 3 * size")
        assert got.count() == 0
        a, b = (sorted(map(repr, map(tuple, mixing.mixed(frame).collect()))) for _ in range(2))
        assert a == b
        total = mixing.mixed(frame).agg(F.sum("taken"), F.sum("size")).first()
        assert abs(total[0] - total[1]) <= 20
        mix = mixing.mixture(frame)
        assert mix.columns == frame.columns and mix.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == total[0]
    assert mixing.mixed(none).count() == 0


# 8


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2, 3, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(none).count() == 0
    assert langid.keep_identified(odd).columns == odd.columns


def test_language_rejects_what_it_did_not_learn(spark):
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = [
        "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю", "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다", "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם",
        "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus", "Gizon-emakume guztiak aske jaiotzen dira, duintasun eta eskubide berberak dituztela",
        *(" ".join("".join(random.Random(99 * j + i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(40)) for j in range(3)), "1234 %%% 5678",
    ]
    rows = learned.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(other)], learned.schema))
    kept = [r.doc_id for r in langid.keep_identified(rows).select("doc_id").collect()]
    assert [i for i in kept if i < 0] == [] and len(kept) >= 0.995 * learned.count()


# 9


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (None, [1.0] * 8), (305, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()))
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and not any(x is None or x != x for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# The pipeline


def test_pipeline(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    classes = similarity.classes(kept.dropDuplicates(["doc_id"]), 5, Fraction(4, 5))
    assert classes.where("doc_id <> component_id").count() <= 20  # texts cut short by the mix may resemble others
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_sql_names():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_next_document_among_repeated_and_missing_ids(spark, monkeypatch):
    rows = [(7, f"seven {i}") for i in range(20)] + [(None, f"none {i}") for i in range(20)] + [(i, f"text {i}") for i in range(20, 40)] + [(None, None), (7, "seven 3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    got = sorted(map(repr, ((r.doc_id, r.edited_sha256) for r in fingerprint.compare_documents(frame).collect())))
    want = [(d, sha(fingerprint.edited(t, order[(i + 1) % len(order)][1]).encode())) for i, (d, t) in enumerate(order)]
    assert got == sorted(map(repr, want))


def test_join_in_chunks_of_chains_and_strangers(spark, monkeypatch):
    """Chains of near copies across chunks, and sets that share rare shingles but are not similar."""
    rng = random.Random(8)
    rows, n = [], 0
    for c in range(6):
        own = [f"c{c}w{i}" for i in range(80)]
        for _ in range(25):
            own = own[1:] + [f"n{n}"]
            rows.append((n, " ".join(own)))
            n += 1
    shared = [f"s{i}" for i in range(6)]
    for _ in range(60):
        rows.append((n, " ".join(shared + [f"u{n}x{i}" for i in range(12)])))
        n += 1
    rng.shuffle(rows)
    for chunk in (300, 1500):
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        for k, least in ((3, Fraction(9, 10)), (2, Fraction(1, 2))):
            got = {r.doc_id: r.component_id for r in similarity.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, least).collect()}
            assert got == brute(rows, k, least)


def test_likenesses_are_those_of_the_pieces(docs):
    rows = {r.doc_id: r.text for r in docs.limit(60).collect()}
    ids = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprint.compare_documents(docs.where(F.col("doc_id").isin(*ids))).collect()}
    plain = lambda a, b: 2 * len(np.intersect1d(a, b)) / (len(a) + len(b)) if len(a) + len(b) else 1.0
    for i, d in enumerate(ids):
        text, after = rows[d], rows[ids[(i + 1) % len(ids)]]
        own, new, following = fingerprint.digests([text, fingerprint.edited(text, after), after])
        assert got[d].near_edited == pytest.approx(plain(own, new)) and got[d].near_next == pytest.approx(plain(own, following))
