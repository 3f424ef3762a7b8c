"""Reading level: regularised character and word models of sentences, aggregated to calibrated document levels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.folding import repair
from inkwell.plans.runtime import ship_package

LEVELS = ("easy", "standard", "demanding")
#: Bound of the labelled sample the models are fitted on (documents); every document is then classified whole.
SAMPLE_DOCS = 2_000
BITS = 17
GRAMS = 4

_WRAPPED = re.compile(r"(?<![.!?:;])[ \t]*\r?\n[ \t]*(?=[a-zäöüß(])")
_END = re.compile(r"(?<=[.!?])(?<!\b\w\.)(?<!\b\d\d\.)[\"“”»«')]*\s+(?=[\"„“»«(•→–-]?\s?[A-ZÄÖÜ0-9])|\s*\r?\n\s*")
_SENTENCE = re.compile(r"(?:[^\W\d_]{2,}\W+){2,}.*[.!?][\"“”»«')\s]*$", re.DOTALL)
_POWERS = (np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 65, 2, dtype=np.uint64)) | np.uint64(1)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: segments of three words or more that a full stop, question or exclamation mark ends. Headings,
    addresses, table rows and list entries are none."""
    if not text:
        return []
    return [s for s in _END.split(_WRAPPED.sub(" ", repair(text))) if s and _SENTENCE.match(s)]


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature indices, start of each sentence's features): hashed words and runs of GRAMS bytes. At least one sentence."""
    raw = [b" " + s.lower().encode() + b"   " for s in parts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8)
    digit = (b >= 48) & (b <= 57)
    letter = (b >= 128) | ((b >= 97) & (b <= 122)) | digit
    x = np.where(letter, np.where(digit, 48, b), 32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    gram = np.zeros(len(x), np.uint64)
    for k in range(GRAMS):
        gram[: len(x) - k] |= x[k:] << np.uint64(8 * k)
    for k in range(1, GRAMS):  # none reaches into the next sentence
        gram[starts[1:] - k] = 0
    gram = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    # words: letters after a non-letter begin one; each letter adds its value times a factor of its place
    begins = np.nonzero(letter & ~np.concatenate([[False], letter[:-1]]))[0]
    if len(begins):
        place = np.arange(len(x)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(x)]])))
        summed = np.add.reduceat(np.where(letter, x * _POWERS[np.minimum(place, 31)], 0).astype(np.uint64), begins)
        word = ((summed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    else:
        word = np.zeros(0, np.int64)
    owner = np.searchsorted(starts, begins, "right") - 1
    words_before = np.searchsorted(owner, np.arange(len(raw) + 1))
    # by sentence: its grams, then its words
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(raw)), lengths), owner]), kind="stable")
    return np.concatenate([gram, word])[order], (starts + words_before)[:-1]


def _means(weights: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(starts, len(index)))
    return np.stack([np.add.reduceat(w[index], starts) for w in weights], 1) / counts[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class LevelModel:
    """Sentence model (hashed word and character weights, L2-regularised) and the document model over its averages."""

    def __init__(self) -> None:
        self.weights = np.zeros((3, 2 << BITS), np.float32)
        self.bias = np.zeros(3)
        self.doc = np.zeros((7, 3))

    def probabilities(self, parts: list[str]) -> np.ndarray:
        index, starts = features(parts)
        return _softmax(_means(self.weights, index, starts) + self.bias)

    def _fit_sentences(self, index, starts, target, weight, epochs=30, l2=1e-6, rate=1.0) -> None:
        counts = np.diff(np.append(starts, len(index)))
        step = np.zeros_like(self.weights)
        owner = np.repeat(np.arange(len(starts)), counts)
        used = np.unique(index)
        compact = np.searchsorted(used, index)
        w, g2, n = self.weights[:, used].copy(), step[:, used].copy() + 1e-8, max(weight.sum(), 1e-9)
        for _ in range(epochs):
            z = np.stack([np.add.reduceat(row[compact], starts) for row in w], 1) / counts[:, None] + self.bias
            grad = (_softmax(z) - target) * weight[:, None] / n
            self.bias -= grad.sum(0)
            for c in range(3):
                g = np.bincount(compact, (grad[:, c] / counts)[owner], len(used)).astype(np.float32) + l2 * w[c]
                g2[c] += g * g
                w[c] -= rate * g / np.sqrt(g2[c])
        self.weights[:, used] = w

    @staticmethod
    def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean distribution over sentences and over characters, each without its middle level, shares of the two outer levels, 1."""
        by_count, by_length = p.mean(0), (p * lengths[:, None]).sum(0) / lengths.sum()
        top = p.argmax(1)
        return np.array([by_count[0], by_count[2], by_length[0], by_length[2], (top == 0).mean(), (top == 2).mean(), 1.0])

    def fit(self, docs: list[tuple[list[str], np.ndarray]]) -> LevelModel:
        """``docs``: sentences and distribution of the raters' levels. Sentences first inherit it; then each keeps of its document's levels what
        the model believes of itself, which sorts out the odd sentence and most rating errors."""
        docs = [(s, y) for s, y in docs if s]
        if not docs:
            return self
        flat = [s for parts, _ in docs for s in parts]
        owner = np.repeat(np.arange(len(docs)), [len(p) for p, _ in docs])
        share = np.stack([y for _, y in docs])
        index, starts = features(flat)
        weight = 1.0 / np.sqrt(np.bincount(owner))[owner]
        target = share[owner]
        self._fit_sentences(index, starts, target, weight)
        for _ in range(2):
            p = _softmax(_means(self.weights, index, starts) + self.bias)
            mixed = p**2 * (0.25 + target)
            self._fit_sentences(index, starts, mixed / mixed.sum(1, keepdims=True), weight, epochs=12)
        p = _softmax(_means(self.weights, index, starts) + self.bias)
        lengths = np.fromiter(map(len, flat), float, len(flat))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner))])
        x = np.stack([self.summary(p[a:b], lengths[a:b]) for a, b in zip(cuts, cuts[1:])])
        self.doc = np.zeros((x.shape[1], 3))
        for step in range(400):
            q = _softmax(x @ self.doc)
            self.doc -= (8.0 / (1 + step / 100)) * (x.T @ (q - share) / len(x) + 2e-4 * self.doc)
        return self

    def document(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _softmax((self.summary(p, lengths) @ self.doc)[None])[0]


def fit_levels(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LevelModel | None:
    """Model fitted on the labelled documents, at most ``sample_docs`` of them (the same ones each time, by hash); None without any."""
    votes = labels.where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "level").distinct()
    votes = votes.groupBy("doc_id").agg(*(F.sum((F.col("level") == v).cast("double")).alias(v) for v in LEVELS))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").collect()  # at most sample_docs rows
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if not rows:
        return None
    return LevelModel().fit([(sentences(r["text"]), np.array([r[v] for v in LEVELS]) / sum(r[v] for v in LEVELS)) for r in rows])


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, sentences, easy, standard, demanding, band): number of sentences, the calibrated probability of each level and the
    likeliest level of each whole text. Texts without sentences, null and blank ones among them, have none and don't appear; neither
    does anything where no label exists. One pass over the corpus, without a shuffle."""
    model = fit_levels(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, sample_docs)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, sentences int, easy double, standard double, demanding double, band string"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # a few hundred texts at a time keep the feature arrays small
                batch = whole.slice(at, 256)
                split = [sentences(t) for t in batch.column(1).to_pylist()]
                rows = [i for i, s in enumerate(split) if s]
                if not rows:
                    continue
                flat = [s for i in rows for s in split[i]]
                p, lengths = m.probabilities(flat), np.fromiter(map(len, flat), float, len(flat))
                cuts = np.cumsum([0] + [len(split[i]) for i in rows])
                q = np.stack([m.document(p[a:b], lengths[a:b]) for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(np.diff(cuts).astype(np.int32)), *(pa.array(q[:, c]) for c in range(3)), pa.array([LEVELS[c] for c in q.argmax(1)])], names=["doc_id", "sentences", *LEVELS, "band"])

    return docs.mapInArrow(classify, schema)
