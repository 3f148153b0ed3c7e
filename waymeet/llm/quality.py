"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word of the corpus has a fixed sparse index vector; a word's own vector is the sum of the index vectors of its
neighbours over all documents, which tasks accumulate in a table of fixed size and Spark sums. A word is what stands
between white space, in its own case, and every ASCII punctuation mark is a word of its own, so that what litters a
text has vectors like any other word. A document is the mean and the root mean square of its words' vectors, and the mean
product of those of neighbours (which tells repetition), and nothing else. A two-layer network is trained on a bounded sample of labelled documents and its probabilities are calibrated by a
temperature that the network was not fitted on.

Defined results: a null or empty text is scored like any other (its vectors are zero); repeated rows get the same score
each; other columns, whatever their names, are ignored; of documents with one doc_id the smallest text is fitted on;
without labels of both classes the score is the labels' smoothed rate, 0.5 without any; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import corpus, text_key, tune
from .sampling import labelled_sample

#: Hashed buckets of the vocabulary; words beyond their number share buckets.
BUCKETS = 1 << 17
DIM = 64
WIDTH = 3 * DIM  # of a document's vector
NONZERO = 2  # of an index vector
WINDOW = 2  # neighbours on each side
CHUNK = 50_000  # words handled at once
#: A word of this share of all words weighs half as much as a rare one.
HALF_SHARE = 1e-3
MARKS = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum()]


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def buckets(text: bytes) -> np.ndarray:
    """The bucket numbers of a text's words, in order."""
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, b" " + mark + b" ")
    words = text.split()
    return np.fromiter(map(crc32, words), np.int64, len(words)) % BUCKETS


def pieces(ids: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A stream in pieces of CHUNK, each led by the last WINDOW of the one before, and how many lead it."""
    for lo in range(0, len(ids), CHUNK):
        lead = min(lo, WINDOW)
        yield ids[lo - lead : lo + CHUNK], lead


class Contexts:
    """How often each bucket occurs, and the sum of its neighbours' index vectors, over the streams added."""

    def __init__(self) -> None:
        self.pos, self.sign = index_vectors()
        self.total = np.zeros((BUCKETS, DIM), np.int32)
        self.seen = np.zeros(BUCKETS, np.int64)
        self.held: list[tuple[np.ndarray, int]] = []
        self.size = 0

    def add(self, stream: np.ndarray) -> None:
        for ids, lead in pieces(stream):
            self.held.append((ids, lead))
            self.size += len(ids)
            if self.size >= CHUNK:
                self.sum_up()

    def sum_up(self) -> None:
        if not self.held:
            return
        ids = np.concatenate([h for h, _ in self.held])
        stream = np.repeat(np.arange(len(self.held)), [len(h) for h, _ in self.held])
        new = np.concatenate([np.arange(len(h)) >= lead for h, lead in self.held])
        used, at = np.unique(ids, return_inverse=True)
        self.seen[used] += np.bincount(at[new], minlength=len(used))
        sums = np.zeros(len(used) * DIM)
        for d in range(1, WINDOW + 1):
            near = (stream[d:] == stream[:-d]) & new[d:]  # pairs of lead words have been counted before
            left, right = np.flatnonzero(near), np.flatnonzero(near) + d
            for x, y in ((left, right), (right, left)):
                for k in range(NONZERO):
                    sums += np.bincount(at[x] * DIM + self.pos[ids[y], k], self.sign[ids[y], k], minlength=len(sums))
        self.total[used] += sums.reshape(-1, DIM).astype(np.int32)
        self.held.clear()
        self.size = 0


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: a row for each bucket that occurs, how often, and its sum of index vectors."""
    sums = Contexts()
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            sums.add(buckets(text.as_py()))
    sums.sum_up()
    used = np.flatnonzero(sums.seen)
    for lo in range(0, len(used), 20_000):
        at = used[lo : lo + 20_000]
        columns = [pa.array(np.ascontiguousarray(sums.total[at, i])) for i in range(DIM)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums.seen[at]), *columns], names=["bucket", "n", *(f"v{i}" for i in range(DIM))])


def word_vectors(docs: DataFrame, splits_a_task: int = 8) -> np.ndarray:
    """The vectors of all buckets (BUCKETS x DIM), from all documents; this table's size does not depend on them.

    A task takes several splits, if there are enough for all cores, as each sends a row for every bucket it has met.
    """
    spark = docs.sparkSession
    tune(spark)
    ddl = "bucket int, n long, " + ", ".join(f"v{i} int" for i in range(DIM))
    text = corpus(docs).select("text")
    splits = text.rdd.getNumPartitions()
    text = text.coalesce(max(1, min(splits, max(spark.sparkContext.defaultParallelism, -(-splits // splits_a_task)))))
    sums = text.mapInArrow(_count_contexts, ddl).groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)))
    got = sums.toArrow()
    vectors, n = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    n[at] = got.column("n").to_numpy()
    for i in range(DIM):
        vectors[at, i] = got.column(f"v{i}").to_numpy()
    return weighted(vectors, n)


def weighted(vectors: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Context sums as vectors of length one, less what all words have in common, frequent words weighing less."""
    share = n / max(1, n.sum())
    v = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    return ((v - share @ v) * (HALF_SHARE / (HALF_SHARE + share))[:, None]).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: its words' vectors' mean, their root mean square, and the mean product of each and the next."""
    out = np.zeros((len(texts), 3, DIM))
    for i, text in enumerate(texts):
        ids = buckets(text)
        for lo in range(0, len(ids), CHUNK):
            part = vectors[ids[lo : lo + CHUNK + 1]]
            one = part[:CHUNK]
            out[i, 0] += one.sum(axis=0)
            out[i, 1] += np.einsum("ij,ij->j", one, one)
            out[i, 2] += np.einsum("ij,ij->j", part[1:], part[:-1])
        out[i, :2] /= max(1, len(ids))
        out[i, 2] /= max(1, len(ids) - 1)
    out[:, 1] = np.sqrt(out[:, 1])
    return out.reshape(-1, WIDTH).astype(np.float32)


@dataclass
class QualityModel:
    """All that scoring needs; its size is fixed."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] | None
    temperature: float
    rate: float  # the score where there is no network

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 11) -> list[np.ndarray]:
    """Two layers by Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 5e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.tanh(x[at] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30)))
            d = (out - y[at]) * weight[at] / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[at].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for a, g, i in zip(p, grads, range(4), strict=True):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                a -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return p


def best_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the network has not seen."""
    tries = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)).sum()) for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, column: str = "quality", per_class: int = 6000) -> QualityModel:
    """Train on about per_class labelled documents of each class where `usable` holds (an expression on doc_id)."""
    vectors = word_vectors(docs)
    sample, weights = labelled_sample(docs, labels, column, usable, per_class)
    n = WIDTH
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool([t.as_py() for t in batch.column("text").cast(pa.binary())], shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(x.ravel()))], names=["doc_id", "label", "x"]
            )

    got = sample.mapInArrow(features, "doc_id long, label int, x array<float>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    y = got.column("label").to_numpy()[order].astype(np.float64)
    none = QualityModel(vectors, np.zeros(n), np.ones(n), None, 1.0, float((y.sum() + 1) / (len(y) + 2)))
    if len(set(y.tolist())) < 2:
        return none
    x = got.column("x").combine_chunks().values.to_numpy().reshape(-1, n)[order].astype(np.float64)
    w = np.array([weights[int(k)] for k in y])
    w /= w.mean()
    none.mean, none.scale = x.mean(axis=0), np.maximum(1e-6, x.std(axis=0))
    z = (x - none.mean) / none.scale
    held = np.random.default_rng(5).random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    none.layers = train_network(z[~held], y[~held], w[~held])
    if held.any():
        none.temperature = best_temperature(none.logits(x[held]), y[held], w[held])
    return none


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per document: doc_id, score, text_key."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool([t.as_py() for t in batch.column("text").cast(pa.binary())], shared.value.vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x).astype(np.float64)), batch.column("text_key")], names=["doc_id", "score", "text_key"])

    return corpus(docs).withColumn("text_key", text_key()).mapInArrow(run, "doc_id long, score double, text_key long")


def drop_rejected(docs: DataFrame, model: QualityModel, at_least: float = 0.3) -> DataFrame:
    """The rows of docs that score at_least or more, with all their columns; every row is scored on its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tune(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        texts = [(t or "").encode() for t in text]
        return pd.Series(shared.value.score(pool(texts, shared.value.vectors)))

    return docs.filter(scored(F.coalesce(F.col("text"), F.lit(""))) >= at_least)
