import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlake.llm import byte_bpe

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    with open(byte_bpe.DEFAULT_VOCABULARY, "rb") as f:
        mine = byte_bpe.coder(f.read())
    theirs = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    return mine, theirs


def same(both, text):
    mine, theirs = both
    return mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids and mine.count(text) == len(mine.encode(text))


HARD = ["", " ", "\n\n \t x", "a" * 5000, "ab" * 3000, "<|endoftext|>", "don't we'll I'M", "ශ්‍රී ලංකා", "விலை ரூ. 100", "👨‍👩‍👧 👍🏽", "​﻿\xa0", "1234567 ½ ⅷ ١٢", "_" * 999 + "=" * 77, "zażółć\r\ngęślą", "\x00\x07", "𝒳" * 50, "the" * 400]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(both, text):
    assert same(both, text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    assert same(both, text.encode("utf-8", "ignore").decode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstu '\n.é්ක0", max_size=120))
def test_mergeable_text(both, text):
    assert same(both, text)


def test_a_small_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    fresh = byte_bpe.ByteBPE([t.encode("latin-1") for t in both[0].tokens])
    text = "many different words go through a memory of three pieces " * 3
    assert fresh.encode(text) == both[0].encode(text) and len(fresh) <= 3


def test_every_document_has_a_list(spark, data, both):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode_corpus(docs).collect()}
    want = {r.doc_id: both[1].encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
    assert got == want


def test_nulls_long_texts_clashes_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "FLUSH", 10)
    rows = [(1, None, 5), (2, "", 5), (None, "x y", 5), (4, "word " * 20_000, 5), (4, "word", 5), (4, "word", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, len(r.ids)) for r in byte_bpe.encode_corpus(df).collect())
    assert got == [(0, 2), (1, 0), (2, 0), (4, 1), (4, 1), (4, 20_001)]
    assert byte_bpe.encode_corpus(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in byte_bpe.token_counts(df, ["doc_id"]).collect()) == [0, 0, 1, 1, 2, 20_001]
