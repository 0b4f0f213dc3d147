from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricetide.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def other():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Hello world", "  two  blanks\n\n", "l'écran d'été", "سعر 1.200 دج", "日本語 😀", "<|endoftext|>", "a" * 5000, "​ ", "I'll we're", "0123456789" * 30])
def test_like_the_library(other, text):
    e = bpe.encoder(PATH)
    assert e.encode(text) == other(text)
    assert e.decode(e.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    tokenizers = pytest.importorskip("tokenizers")
    t = test_any_text.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(PATH))
    t.encode_special_tokens = True
    e = bpe.encoder(PATH)
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert e.decode(e.encode(text)) == text


def test_corpus(spark, data, other):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got == {d: other(t) if t else [] for d, t in texts.items()}
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert back == {d: t or "" for d, t in texts.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    df = bpe.encoded(docs)
    assert df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted([(r["doc_id"] or 0, r["ids"]) for r in df.collect()]) == [(0, [65]), (1, []), (2, []), (3, [64]), (3, [64])]
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_rows_come_from_the_gadgets():
    """Without the merges' gadgets every token arc stays, and the run is another one."""
    e = bpe.encoder(PATH)
    v = e.automaton.v
    assert len(e.automaton.owner) == len(v.merged) + 1
    bare = bpe.Automaton(v)
    bare.cut = {u: {} for u in bare.cut}
    words = [w.encode() for w in ("hello", "unbelievable", "écran")]
    assert [bare.word(w) for w in words] != [e.automaton.word(w) for w in words]


def test_a_full_byte_table_is_begun_anew():
    v = bpe.encoder(PATH).automaton.v
    small, large = bpe.Automaton(v, most_rows=20), bpe.Automaton(v)
    words = [f"word{i} unusual".encode() for i in range(50)]
    assert [small.word(w) for w in words] == [large.word(w) for w in words]
    assert len(small.delta) < 60 < len(large.delta)
