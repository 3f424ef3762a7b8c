"""Encoding a whole corpus with a public byte-level tokenizer, each distinct word encoded once."""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.plans.runtime import ship_package

#: Documents per bucket: bounds the words and texts one task holds at a time, whatever the corpus.
BUCKET_DOCS = 2048


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def words_of(text: str) -> list[str]:
    """The pre-tokens of a text, in order; joined they give the text again."""
    return _pattern().findall(text)


def _distinct_words(docs: pa.Table) -> pa.Table:
    seen: dict[str, None] = {}
    for chunk in docs["text"].chunks:
        for text in chunk.to_pylist():
            if text:
                seen.update(dict.fromkeys(words_of(text)))
    bucket = docs["bucket"][0].as_py() if docs.num_rows else 0
    return pa.table({"bucket": pa.array([bucket] * len(seen), pa.int64()), "word": pa.array(seen.keys(), pa.string())})


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens; one row per row of ``docs``.

    Null and empty texts get an empty list. A string that looks like a special token is ordinary text. Rows with null
    or repeated doc_id are encoded like any other. Columns of other names don't matter.

    Documents are hashed into buckets of about ``bucket_docs``; every bucket gives its distinct words, these are shuffled by
    word and sorted, so that all requests for one word are neighbours and it is encoded once; the ids go back to
    the buckets that asked, and each text is reassembled by the positions of its words. A row per position never
    travels: a word crosses the network once per bucket, however often it is repeated there.
    """
    ship_package(docs.sparkSession)
    path = path or vocabulary_path()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    buckets = max(1, math.ceil(docs.count() / bucket_docs))
    bucketed = docs.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.length("text")), F.lit(buckets)).cast("bigint"))
    # partitions follow the documents, so the largest task stays as it is when the corpus grows
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 2))
    bucketed = bucketed.repartition(parts, "bucket")
    wanted = bucketed.groupBy("bucket").applyInArrow(_distinct_words, "bucket bigint, word string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, ids = _encoding(path), None, []
        for batch in batches:
            out: list[bytes] = []
            for word in batch.column(1).to_pylist():
                if word != last:
                    last, ids = word, np.array(enc._encode_single_piece(word), np.int32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["bucket", "word", "ids"])

    encoded = wanted.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "bucket bigint, word string, ids binary")

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        ids = {w: np.frombuffer(b, np.int32).tolist() for w, b in zip(words["word"].to_pylist(), words["ids"].to_pylist())}
        offsets, flat = [0], []
        for one in texts["text"].to_pylist():
            if one:
                for word in words_of(one):
                    flat += ids[word]
            offsets.append(len(flat))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32()))
        return pa.table({"doc_id": texts["doc_id"], "ids": lists.cast(pa.list_(pa.int32()))})

    return bucketed.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInArrow(reassemble, f"doc_id {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the texts that ``encode_corpus`` was given. Each id is looked up in the table of token bytes, whose size
    is that of the vocabulary; a null list gives null, an empty list the empty text."""
    path = path or vocabulary_path()
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in _ranks(path).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(decode, f"doc_id {kind}, text string")
