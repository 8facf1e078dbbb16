"""Ids against the same vocabulary in two libraries."""

import base64
import os
import random

import pytest
from helpers import tuples, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumdex.llm import encode

FOLDER = os.path.dirname(encode.BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    with open(encode.BYTE_BPE, "rb") as f:
        return encode.Encoder(f.read())


@pytest.fixture(scope="module")
def right():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.WORDS.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(encoder, texts):
    flat, counts = encoder.encode(texts)
    out, at = [], 0
    for c in counts:
        out.append(flat[at : at + c].tolist())
        at += c
    assert at == len(flat)
    return out


def texts(seed):
    r = random.Random(seed)
    some = ["aaaa", "the", "ing", "é", "и", "😀", "  ", "\n", "\r\n", "0", "12", "-", "=", "<|endoftext|>", "\x00", "zz", "ab", "Ā", "'ll", "​", "ſ", "½"]
    yield from ("".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(1500))
    yield from ("".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(1, 30))) for _ in range(3000))
    yield from ("".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1000), r.randint(0x3040, 0x30FF), r.randint(0x1F600, 0x1F640)])) for _ in range(60)) for _ in range(800))


def test_ids_are_right(encoder, right):
    every = list(texts(1))
    assert ids(encoder, every) == [right(t) for t in every]
    assert 0 < encoder.exact_words < encoder.new_words


def test_another_library_agrees(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.BYTE_BPE)
    t.encode_special_tokens = True
    every = list(texts(2))
    assert ids(encoder, every) == [e.ids for e in t.encode_batch(every, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(encoder, right, text):
    assert ids(encoder, [text]) == [right(text)]


def test_exact_merging_alone(encoder, right):
    for t in texts(3):
        for w in encode.WORDS.findall(t)[:3]:
            assert encoder.merge_exactly(w.encode()) == right(w)


def test_very_long_words_and_texts(encoder, right):
    r = random.Random(4)
    long = ["a" * 50_000, "ab" * 30_000, " " * 40_000, "".join(r.choice("abcdefgh") for _ in range(60_000)), "word " * 100_000]
    assert ids(encoder, long[:1] + long[2:3] + long[4:]) == [right(t) for t in long[:1] + long[2:3] + long[4:]]
    assert all(encode.Encoder.merge_exactly(encoder, t.encode()) == i for t, i in zip(long[1:4:2], ids(encoder, long[1:4:2]), strict=True))
    assert not any(len(w) > encode.CACHED_CHARS for w in encoder.known)


def test_rows(spark, right):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "The end"), (4, "The end"), (None, "x"), (5, "<|endoftext|>")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode.token_ids(df).collect()), key=repr)
    assert got == sorted(((d, right(t or "")) for d, t in rows), key=repr)
    assert encode.token_ids(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tuples(encode.token_counts(df)) == sorted(((d, len(right(t or ""))) for d, t in rows), key=repr)
    assert tuples(encode.token_ids(df.limit(0))) == []


def test_bytes_that_are_no_text(spark, right):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert list(encode.token_ids(df).first()["ids"]) == right("a�b")


def test_parts_cover_all():
    many = ["x" * n for n in (0, 5, 0, 100, 3, 3, 3, 0)]
    parts = list(encode.in_parts(many, 7))
    assert [k for a, b in parts for k in range(a, b)] == list(range(len(many))) and list(encode.in_parts([])) == []
