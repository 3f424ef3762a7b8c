from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwell.llm.tokens import _encoding, decode_corpus, encode_corpus, vocabulary_path, words_of

SCHEMA = "doc_id bigint, text string, ids string, bucket int"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_words_encode_like_the_whole(text):
    enc = _encoding(vocabulary_path())
    words = words_of(text)
    assert "".join(words) == text
    assert [i for w in words for i in enc._encode_single_piece(w)] == enc.encode_ordinary(text)


def test_corpus(spark, reference):
    texts = ["", None, "  ", "Grüße aus Köln!  \n\n Ja", "<|endoftext|> is text", "🌻👵🏽 x​y\xa0z", "wort " * 5000, "a\tb\r\nc", "Copy", "Copy", "1234567890 12,5 €"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 2), (3, "second three", "", 0)]
    encoded = encode_corpus(spark.createDataFrame(rows, SCHEMA), bucket_docs=3)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted((r[0] is not None, r[0] or 0, list(r[1])) for r in encoded.collect())
    assert got == sorted((i is not None, i or 0, reference.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows)
    back = sorted((r[0] is not None, r[0] or 0, r[1]) for r in decode_corpus(encoded).collect())
    assert back == sorted((i is not None, i or 0, t or "") for i, t, _, _ in rows)


def test_nothing(spark):
    assert encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in decode_corpus(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")).orderBy("doc_id").collect()] == [(1, None), (2, "")]
