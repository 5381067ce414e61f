"""Prefix counts against the library's encoder."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm.token_counts import counter, token_counts, truncations

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", "   ", "a<|endoftext|>b", "<|startoftext|><|endoftext|> <|x|>", "İstanbul ŉ ß", "ΣΑΣ ΟΔΟΣ", "日本語 テスト123", "it's we'll 'tis don'T",
    "a\x1cb\x1dc", " x y\x85z", "😀😀 a😀", "²³½ Ⅷ x²", "ab́c 'S", "\x00\x01", "naïve—“quotes”…", "ㅎㅏㄴ 한글", "x" * 300, "!" * 700, "…" * 50,
]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert counter(PATH).count(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAeéß'sStlrve .,!1²\n\x1f|<>", max_size=60))
def test_any_text(text):
    assert counter(PATH).count(text) == library(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abethEéóß'sreInv .,!12\nдж", max_size=40))
def test_every_prefix(text):
    assert counter(PATH).prefix_counts(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


def test_frame(spark):
    long = "ingestion of words " * 30_000
    rows = [(1, "Hello there!", "x"), (2, None, "x"), (2, None, "x"), (3, "", None), (None, "one two", "y"), (4, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, PATH, 2048).collect()), key=str)
    want = [(k, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for k, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH, 2048).collect() == []


def test_truncations(spark):
    docs = spark.createDataFrame([(1, "The quick brown foxes jumped over it."), (2, None)], "doc_id long, text string")
    for row in truncations(docs, PATH, [0, 3, 1000]).collect():
        text = "The quick brown foxes jumped over it." if row.doc_id == 1 else ""
        fits = [i for i in range(len(text) + 1) if library(text[:i]) <= row.budget]
        assert (row.n_chars, row.n_tokens) == (max(fits), library(text[: max(fits)]))
