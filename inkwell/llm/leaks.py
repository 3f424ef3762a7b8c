"""Held-out items inside a corpus: prefix-filtered set join on word shingles, verified over item-sized windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.folding import folded_words
from inkwell.plans.runtime import cut, ship_package, skew_join

SHINGLE = 5
#: Share of an item that counts as about half, and share of its words that must agree (about one in ten may differ, ends included two).
PASSAGE, AGREE = 0.4, 0.8
#: Bits of a sieve: 64 for each shingle, within these bounds.
SIEVE_BITS = (1 << 22, 1 << 28)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_KNOWN: dict[str, int] = {}


def least_overlap(n_words: int) -> int:
    """Shingles of an item of ``n_words`` that a passage of about half of it certainly holds when about every eighth of the passage's words is changed; one at least."""
    half = math.ceil(0.45 * n_words)
    return max(1, half - SHINGLE + 1 - SHINGLE * math.ceil(0.13 * half))


def word_ids(text: str) -> np.ndarray:
    """A 63-bit id of each word of ``text``, the same wherever it is taken."""
    if len(_KNOWN) > 1_000_000:
        _KNOWN.clear()
    words = folded_words(text)
    ids = [*map(_KNOWN.get, words)]
    if None in ids:
        for w in words:
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh3_64_intdigest(w) >> 1
        ids = [*map(_KNOWN.get, words)]
    return np.array(ids, np.int64).view(np.uint64)


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each position."""
    n = len(ids) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ ids[k : k + n]) * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return out


class Sieve:
    """A Bloom filter of shingles: lets all of its own through and few others. Its size has a bound, whatever the number of items."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        return [((hashes * _MULTIPLIERS[k]) >> np.uint64(20)) & mask for k in range(4)]

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that get through."""
        left = np.arange(len(hashes))
        for at in self.places(hashes, self.mask):
            at = at[left]
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left

    @classmethod
    def of(cls, hashed: DataFrame) -> Sieve:
        """Sieve of the column h, built as one bitmap for each of at most eight tasks."""
        count = hashed.count()
        size = min(max(1 << max(0, 64 * count - 1).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                for at in cls.places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.uint64(size - 1)):
                    np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

        bits = np.zeros(size // 8, np.uint8)
        for row in hashed.select("h").coalesce(8).mapInArrow(build, "bits binary").toLocalIterator():
            bits |= np.frombuffer(row[0], np.uint8)
        return cls(bits)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(words of the item covered, words that agree, words of the window covered) in the best local alignment of two word sequences; agreeing
    words count 1, changed, dropped or added ones -2."""
    n, m = len(item), len(window)
    score, steps = np.zeros((n + 1, m + 1)), 2.0 * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1] - 2, 0)
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + np.where(window == item[i - 1], 1, -2))
        score[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(np.argmax(score), score.shape)
    end_i, end_j, agree = i, j, 0
    while i and j and score[i, j] > 0:
        same = item[i - 1] == window[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (1 if same else -2):
            i, j, agree = i - 1, j - 1, agree + int(same)
        elif score[i, j] == score[i - 1, j] - 2:
            i -= 1
        else:
            j -= 1
    return int(end_i - i), agree, int(end_j - j)


class Item:
    """An item's words and where each of its shingles stands."""

    def __init__(self, ids: np.ndarray) -> None:
        own = shingles(ids)
        self.order = np.argsort(own, kind="stable")
        self.sorted, self.words, self.least = own[self.order], ids.astype(np.uint32), least_overlap(len(ids))

    def held_by(self, hashes: np.ndarray, at: np.ndarray, words: np.ndarray) -> bool:
        """Whether a text holds the item or about half of it: enough shared shingles within an item-sized window, then word alignment there.
        ``hashes`` of the text's shingles stand ``at`` these places of its ``words`` (32 bits each)."""
        n, need, slack = len(self.words), max(SHINGLE, PASSAGE * len(self.words)), math.ceil(0.15 * len(self.words))
        lo, hi = np.searchsorted(self.sorted, hashes, "left"), np.searchsorted(self.sorted, hashes, "right")
        hits = sorted((int(at[k]) - int(off), int(off)) for k in np.nonzero(hi > lo)[0] for off in self.order[lo[k] : hi[k]])
        diagonals = [d for d, _ in hits]
        a, tried = 0, None
        for b in range(len(hits)):
            while diagonals[b] - diagonals[a] > slack:
                a += 1
            if b - a + 1 < self.least or (b + 1 < len(hits) and diagonals[b + 1] - diagonals[a] <= slack):
                continue
            if len({off for _, off in hits[a : b + 1]}) < self.least:
                continue
            # the window that an item on these diagonals would fill, a slack wider at either end
            first, last = max(0, diagonals[a] - slack), min(len(words), diagonals[b] + n + slack)
            if tried == (first, last):
                continue
            tried = (first, last)
            covered, agree, there = align(self.words, words[first:last])
            if covered >= need and agree >= AGREE * max(covered, there):
                return True
        return False


def holds(own: np.ndarray, words: np.ndarray) -> bool:
    """Whether the text of ``words`` holds the item of words ``own`` or about half of it."""
    h = shingles(words)
    return Item(own).held_by(h, np.arange(len(h)), words.astype(np.uint32))


def _item_rows(items: DataFrame) -> DataFrame:
    """(item_id, words, hs, least) of items with five words or more."""
    kind = dict(items.dtypes)["item_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, words, hs, least = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if len(ids := word_ids(text)) >= SHINGLE:
                    keep.append(row)
                    words.append(ids.tobytes())
                    hs.append(np.unique(shingles(ids)).view(np.int64))
                    least.append(least_overlap(len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(words, pa.binary()), pa.array(hs, pa.list_(pa.int64())), pa.array(least, pa.int32())], names=["item_id", "words", "hs", "least"])

    return cut(items.mapInArrow(read, f"item_id {kind}, words binary, hs array<bigint>, least int"))


def shingle_hits(docs: DataFrame, sieve: Sieve, fewest: int) -> DataFrame:
    """(doc_id, uid, hs, at, words): of each text with any shingle that the sieve lets through those shingles and where they stand, and its words where
    the shingles are as many as the least demanding item asks. The one scan of the texts."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, hs, places, words = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                h = shingles(ids := word_ids(text))
                if len(at := shared.value.passed(h)):
                    keep.append(row)
                    hs.append(h[at].view(np.int64))
                    places.append(at.astype(np.int32))
                    words.append(ids.astype(np.uint32).tobytes() if len(at) >= fewest else None)
            owner = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([owner, pa.array(hs, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.binary())], names=["doc_id", "hs", "at", "words"])

    return cut(docs.mapInArrow(scan, f"doc_id {kind}, hs array<bigint>, at array<int>, words binary").withColumn("uid", F.xxhash64("hs", "at", "words")))


def shingle_counts(hits: DataFrame) -> DataFrame:
    """(h, n): in how many texts each shingle stands."""
    return hits.select(F.explode(F.array_distinct("hs")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def prefixes(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, item_id): of each item's shingles the |S| - t + 1 that are rarest in the corpus: a text that shares t of them shares one of these."""
    own = items.select("item_id", "least", F.size("hs").alias("size"), F.explode("hs").alias("h")).join(counts, "h", "left")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "h"))  # the shingles of one item
    return own.withColumn("rank", rank).where(F.col("rank") <= F.greatest(F.lit(1), F.col("size") - F.col("least") + 1)).select("h", "item_id")


def candidate_pairs(hits: DataFrame, own: DataFrame, prefix: DataFrame) -> DataFrame:
    """(doc_id, uid, item_id): texts and items that share a prefix shingle and as many shingles as the item asks."""
    texts = hits.where("words is not null")
    pairs = skew_join(texts.select("doc_id", "uid", F.explode(F.array_distinct("hs")).alias("h")), prefix, ["h"], "uid").select("doc_id", "uid", "item_id").distinct()
    asked = skew_join(cut(pairs), own.select("item_id", F.col("hs").alias("theirs"), "least"), ["item_id"], "uid")
    enough = asked.join(texts.select("doc_id", "uid", "hs"), ["doc_id", "uid"]).where(F.size(F.array_intersect("hs", "theirs")) >= F.col("least"))
    return cut(enough.select("doc_id", "uid", "item_id").distinct())


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold a held-out item, or a connected passage of about half of it or more.

    Case, punctuation, spacing, markup and encoding may differ, and about one word in ten may be changed, dropped or added.
    Rows without id or text give nothing; repeated rows give one row. A passage has five words at least, so items under five words give nothing.

    One scan of the whole texts keeps the shingles that a sieve of the items' shingles lets through; its size has a bound, so the number of items adds no scan
    and nothing that grows with it is broadcast. In how many documents each stands orders an item's shingles by rarity, and only the necessary rarest
    (|S| - t + 1, t being what about half an item certainly shares) are joined, hot shingles and items spread. Each pair of
    document and item is then verified exactly: t shingles within an item-sized window, then word alignment there.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(items.select(item_id).dtypes)[item_id]
    own = _item_rows(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").dropDuplicates(["item_id"]))
    hits = shingle_hits(docs, Sieve.of(own.select(F.explode("hs").alias("h")).distinct()), own.agg(F.min("least")).head()[0] or 1)
    pairs = candidate_pairs(hits, own, cut(prefixes(own, shingle_counts(hits))))
    with_item = skew_join(pairs, own.select("item_id", F.col("words").alias("item")), ["item_id"], "uid")
    checked = with_item.join(hits, ["doc_id", "uid"]).select("doc_id", "item_id", "item", "hs", "at", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Item] = {}
        for batch in batches:
            keep = []
            for row, (raw, hs, at, words) in enumerate(zip(batch.column(2).to_pylist(), *(batch.column(k) for k in (3, 4, 5)))):
                if raw not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[raw] = Item(np.frombuffer(raw, np.uint64))
                if known[raw].held_by(hs.values.to_numpy().view(np.uint64), at.values.to_numpy(), np.frombuffer(words.as_py(), np.uint32)):
                    keep.append(row)
            yield batch.select(["doc_id", "item_id"]).take(pa.array(keep, pa.int64()))

    return checked.mapInArrow(verify, f"doc_id {kind}, item_id {item_kind}").distinct()
