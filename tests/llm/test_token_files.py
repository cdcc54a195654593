"""Operator 5, and the cutting of texts that it shares with operator 1."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrafold.llm import bpe, repair


@pytest.fixture(scope="module")
def encoder():
    with open(repair.TOKENIZER) as f:
        return repair.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(repair.TOKENIZER)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice("ab cd'st\n\t  éü漢字🙂1২\x1c\x85\xa0.,!?<|²ªⅧ_'") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == ids_of(library, text), text
    for text in ("a <|endoftext|> b<|endoftext|>c", "x <| y", "a  b  c. d,  e\n f", "", " "):
        assert encoder.encode(text) == ids_of(library, text), text


def test_texts_encoded_together_have_the_ids_of_the_library(library, monkeypatch):
    rng = random.Random(3)
    some = ["word", "don't", "'s", "it's,", "x1.", "2nd", "(a)", "é,", "für", "…,", "ab\ncd", "e.\nF", "\tq", "r\n\ns", "\x85", "u\xa0v", "漢字。", "🙂", "a_b", "\0", "ab\0", "z" * 70, "y" * 69 + "x", "<|", ".\n"]
    texts = [rng.choice(["", "", " ", "\n"]) + rng.choice("  \n").join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(600)]
    texts = [t.replace("  ", " ") if rng.random() < 0.8 else t for t in texts]
    texts += ["", " ", "\n", "a\n ", "a ", "<|endoftext|>b", "x" * 3000, " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(3000))]
    want = [ids_of(library, t) for t in texts]
    with open(repair.TOKENIZER) as f:
        definition = f.read()
    # Few slots, and hashes that tell chunks of one length apart no more; parts of texts; little that is held; no wall.
    for changed in ({}, {"_VALUES": np.ones_like(repair._VALUES), "SLOTS": 8}, {"PART": 50, "TOGETHER": 3}, {"PART": 500, "HELD": 20}, {"PART": 500, "HELD_BYTES": 900}, {"wall": None}):
        with monkeypatch.context() as m:
            for name in changed.keys() - {"wall"}:
                m.setattr(repair, name, changed[name])
            own = repair.Encoder(definition)
            assert own.wall
            if "wall" in changed:
                own.wall = None
            for _ in range(2):
                assert list(own.encode_all(texts)) == want, changed
            assert len(own.known.n) <= repair.HELD and len(own.known.data) + 4 * len(own.known.ids) <= repair.HELD_BYTES, changed


def test_new_words_go_to_the_model_together_and_known_ones_hardly_again():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(5000))
    with open(repair.TOKENIZER) as f:
        own = repair.Encoder(f.read())
    calls, merge = [], own.merge
    own.merge = lambda x: calls.append(x) or merge(x)
    list(own.encode_all([text]))
    assert len(calls) <= 5000 / repair.TOGETHER + 1
    calls.clear()
    list(own.encode_all([text]))
    # Words that share a slot.
    assert sum(x.count("\u0120") for x in calls) < 50


def test_doubly_spaced_texts_are_cut_and_what_is_remembered_is_bounded(encoder, library, monkeypatch):
    rng = random.Random(1)
    texts = ["  ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300)) + ".  " + "x" * 5000 for _ in range(20)]
    assert all(len(bpe.chunks_of(t)[1]) > 250 for t in texts)
    monkeypatch.setattr(repair, "REMEMBERED", 500)
    with open(repair.TOKENIZER) as f:
        own = repair.Encoder(f.read())
    for m in (own.spaced, own.piece, own.bare):
        m.most = 500
    assert [own.encode(t) for t in texts] == [ids_of(library, t) for t in texts]
    for m in (own.spaced, own.piece, own.bare):
        assert len(m) <= 500 and len(m.older) <= 500 and max(map(len, [*m, *m.older]), default=0) <= repair.LONGEST
    with open(bpe.VOCABULARY, "rb") as f:
        merges = bpe.Merges(f.read())
    for t in texts:
        first, rest = bpe.chunks_of(t)
        merges.learn([first], rest)
    merges.learn([])
    assert max(map(len, [*merges.seen, *merges.seen_spaced])) <= bpe.LONGEST


def apart(seq):
    """How often each pair occurs without overlap, from the left."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return counts


@pytest.mark.parametrize("least", [2, repair.LEAST])
def test_no_frequent_pair_is_left(least):
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, np.int64), np.ones(999, np.int64), np.tile([5, 6, 7], 500), rng.integers(0, 9, 20_000), np.repeat(rng.integers(0, 4, 3000), 3), np.tile(rng.integers(0, 999, 400), 6)):
        first, rules, seq = repair.grammar(ids, least)
        assert max(apart(seq.tolist()).values(), default=0) < max(least, 2)
        assert repair.expand(first, rules, repair.lengths(first, rules), seq).tolist() == ids.tolist()
        assert len(seq) + 2 * len(rules) <= len(ids) or least == 2


def test_a_span_is_read_from_its_blocks(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 64)
    ids = np.random.default_rng(2).integers(0, 50, 30_000)
    blob = repair.pack(np.array([7, 0]), np.array([True, False]), np.array([10_000, 20_000]), ids)
    shard = repair.Shard(blob)
    assert [x.tolist() for x in shard.documents()] == [[7, 0], [True, False], [10_000, 20_000]]
    assert shard.ids(12_345, 100).tolist() == ids[12_345:12_445].tolist() and shard.inflated <= 3 < len(shard.before)
    assert shard.ids(0, 30_000).tolist() == ids.tolist() and shard.ids(29_999, 1).tolist() == ids[-1:].tolist() and len(shard.ids(5, 0)) == 0
