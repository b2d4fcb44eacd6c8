import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm.bpe import TOKENIZERS, count_tokens, decode_documents, encode_documents, encoder

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
HARD = ["", " ", "<|endoftext|> it's", "a²b ½", "x\x1cy \x1f z", "'s 'S we'LL", "Ⅷx 五 ١٢٣٤", "_a_ __ -_-", "\U0001f600 ok", "  \n\n a \t b\r\n", "x\xa0y　z w\x85v", "é é ไทย๑๒", "abc " * 500, "q" * 5000, "ªº aᵃb Ⓐⓑ", "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nÃ\xa0 lÃ\xa0"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_hard_texts_like_the_library(library):
    e = encoder()
    for t in HARD:
        ids = list(e.encode(t))
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert e.decode(ids) == t and e.count(t) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text_like_the_library(library, t):
    e = encoder()
    ids = list(e.encode(t))
    assert e.decode(ids) == t and ids == library.encode(t, add_special_tokens=False).ids


def test_every_character_is_classed_like_the_library(library):
    e = encoder()
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(every), 997):
        t = " ".join(f"a{c}1{c} {c}" for c in every[i : i + 997])
        assert e.split(t) == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)], i


def test_a_small_cache_changes_nothing():
    from strandmill.llm.bpe import Encoder

    small = Encoder(encoder().ranks, cache_pieces=2)
    for t in HARD:
        assert list(small.encode(t)) == list(encoder().encode(t))


def test_tables(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(HARD)] + [(90, None, 1, "y"), (91, "word " * 100_000, 1, "z"), (0, HARD[0], 1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    out = encode_documents(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r.doc_id, r.ids) for r in out.collect())
    assert got == sorted((r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    back = {r.doc_id: r.text for r in decode_documents(out).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows)
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, {"doc_id": df.doc_id}, df.text).collect()}
    assert all(counts[d] == len(ids) for d, ids in got)
    assert encode_documents(df.limit(0)).collect() == []
