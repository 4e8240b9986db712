from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.queries import FOLDER

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    v = bpe.read_vocabulary(f"{FOLDER}/{request.param}.tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})
    return v, bpe.Encoder(v), other


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_the_library(both, text):
    v, own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert v.decode(ids) == text


def test_hard_pieces(both):
    _, own, other = both
    rng = random.Random(1)
    for s in ("a" * 5000, "ab" * 3000, " " * 999, "\n" * 50 + "x", "é" * 700, "<|endoftext|>", "'s'S", *("".join(rng.choice("abcdefetheingo aA1\tж文0") for _ in range(60)) for _ in range(300))):
        assert own.encode(s) == other.encode_ordinary(s)


def test_forgetting_changes_nothing(both, monkeypatch):
    v, own, _ = both
    small = bpe.Encoder(v)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    text = "one two three four one two three four " * 5
    assert small.encode(text) == own.encode(text)


def test_corpus(spark):
    v = bpe.read_vocabulary(f"{FOLDER}/byte_bpe_50k.tiktoken")
    rows = [(1, None, 9), (2, "", 9), (3, "  ", 9), (4, "Hello", 9), (4, "Hello", 9), (5, "x" * 20000, 9), (None, "a", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe.encode_corpus(df, v).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[1] == [] and by[2] == [] and v.decode(by[3]) == "  " and v.decode(by[5]) == "x" * 20000 and v.decode(by[None]) == "a"
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, v).collect()}
    assert counts == {k: len(x) for k, x in by.items()}
    assert bpe.encode_corpus(df.limit(0), v).count() == 0
