"""Quality classifier: supervised subword embeddings.

Each word has a vector for itself and one for each of its character trigrams (over UTF-8 bytes), hashed into a fixed table; a
document is the mean of all its vectors and a softmax over it gives the class. Vectors and output weights are
learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``per_class`` rows a class, ``max_bytes`` of text). A word that repeats the word before it adds one more
feature, so texts that stutter differ from texts that use the same words once.

Scoring reads every whole text once, in tasks, with no shuffle. Because the output is linear in the mean, a
word's share of the two logits is one number; it is worked out once per distinct word of a task.

Rows: null and empty texts get the score of the bias alone; very long texts are read whole; without labels of
both classes every score is the share of label 1 among those there are (1.0 where there are none).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices

BUCKETS = 1 << 17
WORD_ENTRIES = 400_000
REPEAT = zlib.crc32(b"\x02repeat") & (BUCKETS - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words that aren't empty: the hashed id of each, those of all their byte trigrams (with marks at both
    ends) in a row, and where each word's begin."""
    coded = [w.encode() for w in words]
    whole = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) & (BUCKETS - 1)
    marked = np.frombuffer(b"<" + b"><".join(coded) + b">", np.uint8).astype(np.uint32)
    mixed = (marked[:-2] * np.uint32(0x9E3779B1)) ^ (marked[1:-1] * np.uint32(0x85EBCA77)) ^ (marked[2:] * np.uint32(0xC2B2AE3D))
    mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(15)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    begins = np.cumsum(sizes + 2) - sizes - 2
    inside = np.ones(len(mixed), bool)
    ends = begins + sizes
    for over in (ends, ends + 1):  # trigrams that reach into the next word
        inside[over[over < len(mixed)]] = False
    return whole, mixed[inside].astype(np.int64), np.cumsum(sizes) - sizes


def doc_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text's features and their shares."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    whole, parts, _ = word_features(words)
    repeats = np.full(4 * sum(map(eq, words, islice(words, 1, None))), REPEAT)
    ids, counts = np.unique(np.concatenate([whole, parts, repeats]), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


class Model:
    """weights[f]: the difference that feature f makes between the two logits; bias likewise."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)


def train(rows: list[tuple[str, int]], *, dim: int = 8, epochs: int = 6, rate: float = 4.0, seed: int = 1) -> Model:
    """One step of gradient descent per document, in a new order each epoch, at a falling rate."""
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    docs, rng = [doc_features(text) for text, _ in rows], np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    weight = (len(y) / (2.0 * np.bincount(y, minlength=2))).astype(np.float32)  # both classes count alike
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            (ids, share), lr, step = docs[i], rate * (1 - step / steps), step + 1
            rows_ = vectors[ids]
            mean = share @ rows_
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            vectors[ids] = rows_ - np.outer(lr * share, p @ out)
            out -= lr * 0.02 * np.outer(p, mean)
            bias -= lr * 0.005 * p
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


class Scorer:
    """Scores texts; words[w] is the sum of a distinct word's weights + i times the number of its features."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, complex] = {}

    def fill(self, words: set[str]) -> None:
        if len(self.words) + len(words) > WORD_ENTRIES:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        if new:
            whole, parts, begins = word_features(new)
            weights = self.model.weights
            sums = np.add.reduceat(weights[parts], begins) + weights[whole]
            counts = np.diff(begins, append=len(parts)) + 1
            self.words.update(zip(new, (sums + 1j * counts).tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        self.fill(set().union(*split))
        return [self.one(words) for words in split]

    def one(self, words: list[str]) -> float:
        total = sum(map(self.words.__getitem__, words), 0j)
        repeats = 4 * sum(map(eq, words, islice(words, 1, None)))
        n = total.imag + repeats
        z = self.model.bias + ((total.real + repeats * float(self.model.weights[REPEAT])) / n if n else 0.0)
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, z))))


def score_texts(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the probability of label 1 of each row's whole text."""
    keep = [c for c in df.columns if c != score_col]
    given, shared = df.select(*(F.col(f"`{c}`") for c in keep)), df.sparkSession.sparkContext.broadcast(model)  # 0.5 MB
    at = keep.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields), f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for part in slices(batches):
            got = pa.array(score([t or "" for t in part.column(at).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*keep, score_col])

    return given.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, train_where, *, label: str = "quality", per_class: int = 1000, max_bytes: int = 24 << 20) -> Model:
    return train(labelled_sample(docs, labels, label, train_where, per_class=per_class, max_bytes=max_bytes))
