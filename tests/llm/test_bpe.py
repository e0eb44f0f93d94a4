"""Prefix tables against public tokenizers and the merge procedure."""

import base64
import random
from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from amperelake.llm import tokens
from amperelake.llm.bpe import PATTERN, SETTING, Bpe, Encoded, Prefixes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def bpe():
    return Bpe(Path(VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "\n\n\t ", "a" * 3000, "<|endoftext|> x", "naïve ½ ﬁ 電池 𐍈", "ನಾಯಿ பேட்டரி बैटरी", "it's we'll I'D", "​﻿", "x" * 70 + "é" * 50, "0x1F 12345678901234567890", "\x00\x07", "👩‍👩‍👧 🚗"]


def test_hard_texts(bpe, public):
    for t in HARD:
        assert bpe.encode(t) == public.encode_ordinary(t), t[:40]
        assert bpe.decode(bpe.encode(t)).decode() == t
    assert bpe.encode(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(bpe, public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encode(text) == public.encode_ordinary(text)


def test_appends_and_edits_equal_a_new_encoding(bpe):
    r = random.Random(2)
    p, plain = Prefixes(bpe), b""
    for _ in range(60):
        bit = bytes(r.choice(b"abetion hous\xc3\xa9") for _ in range(r.randint(0, 6)))
        if plain and r.random() < 0.5:
            at = r.randint(0, len(plain))
            cut = r.randint(0, min(5, len(plain) - at))
            p.edit(at, cut, bit)
            plain = plain[:at] + bit + plain[at + cut :]
        else:
            p.append(bit)
            plain += bit
        assert bytes(p.data) == plain and p.ids() == bpe.merged(plain)


def test_an_edit_refills_only_around_it(bpe, public):
    text = ("The battery pack of vehicle 12 was checked; fans run warm. " * 1800).encode()
    p = Prefixes(bpe, text)
    for at, cut, new in ((10, 3, b"xy"), (50_000, 0, b" unusual"), (len(text) - 5, 2, b""), (70_000, 500, b"q")):
        text = text[:at] + new + text[at + cut :]
        p.edit(at, cut, new)
        assert p.refilled < 1000 and bytes(p.data) == text
        assert p.last == Prefixes(bpe, text).last


@settings(max_examples=120, deadline=None)
@given(st.text("ab 1'\n\u0b95é", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6), st.text("ab 's2\t", max_size=5)), max_size=4))
def test_edits_of_a_text_equal_a_new_encoding(bpe, public, text, edits):
    e = Encoded(bpe, text)
    for at, cut, new in edits:
        at = min(at, len(text))
        text = text[:at] + new + text[at + cut :]
        cut = min(cut, len(e.text) - at)
        assert e.edit(at, cut, new).ids() == public.encode_ordinary(text)
    assert e.append("s end").ids() == public.encode_ordinary(text + "s end")


def test_an_edit_splits_again_only_around_it(bpe):
    e = Encoded(bpe, "The pack was checked twice. " * 2000)
    assert e.edit(20_000, 4, "new").split_again < 10 and e.append(" more").split_again < 10


def test_vocabulary_is_a_parameter(spark, public):
    df = spark.createDataFrame([(1, "fan run")], "doc_id long, text string")
    want = public.encode_ordinary("fan run")
    assert tokens.token_ids(df, vocabulary=VOCABULARY).first().ids == want == tokens.token_ids(df).first().ids
    spark.conf.set(SETTING, VOCABULARY.replace("50k", "multi_50k"))
    try:
        assert tokens.vocabulary_file(spark).endswith("byte_bpe_multi_50k.tiktoken") and tokens.token_ids(df).first().ids != want
    finally:
        spark.conf.unset(SETTING)


def test_every_prefix_has_its_own_last_token(bpe):
    data = b"unbelievable batteries"
    p = Prefixes(bpe, data)
    for i in range(1, len(data) + 1):
        assert p.last[i] == bpe.merged(data[:i])[-1]


def test_table_of_ids(spark, public):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(99, None), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as value", "2 as ids", "3 as n_tokens")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == sorted((i, public.encode_ordinary(t) if t else []) for i, t in rows)
    assert sorted(map(tuple, tokens.token_counts(df).collect())) == sorted((i, len(ids)) for i, ids in got)
    assert tokens.token_ids(df.limit(0)).count() == 0
