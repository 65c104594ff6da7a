"""Quality classifier with supervised subword embeddings: every word and every
character n-gram is hashed to a bucket with a learned vector, a document is the
mean of its features' vectors, and a softmax layer gives its class. Trained by
stochastic gradient descent in numpy.

Features come from the whole text. They are made from arrays of code points,
many documents at once, without a loop over words; a text longer than CHARS is
read in steps, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of words and of character n-grams, n-gram lengths, vector length.
WORD_BUCKETS = GRAM_BUCKETS = 1 << 16
GRAMS = (3, 4)
#: A word n-gram whose last word is its first again has one bucket for each of
#: these distances, whichever word it is: repetition is learned once for all words.
AGAIN = (1, 2)
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS + len(AGAIN)
DIM = 8
#: Labelled documents that are learned from, at most about so many: a share of
#: them all, told by a hash of the id.
TRAIN_DOCS = 2000
#: Steps of one document (passes over them as many as that takes), size of the
#: first step, and how much larger a step the feature vectors take.
STEPS, RATE, VECTOR_RATE = 12_000, 0.5, 5.0
#: Code points that are turned into features at once.
CHARS = 1 << 20
THRESHOLD = 0.7

_P = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _P modulo 2^64.
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (null: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Multiply and shift, with the upper half folded in first."""
    return (((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)


def _grams(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, places, length) of the character n-grams of code points whose
    white space is 32: no space but at the ends."""
    blank, h, inner = c == 32, c.copy(), None
    for length in range(2, max(GRAMS) + 1):
        h = h[:-1] * _P + c[length - 1 :]
        if length > 2:  # no space inside
            inside = ~blank[length - 2 : len(c) - 1]
            inner = inside if inner is None else inner[:-1] & inside
        if length in GRAMS:
            there = np.flatnonzero(inner)
            yield _bucket(h[there] + np.uint64(length), GRAM_BUCKETS) + WORD_BUCKETS, there, length


def long_features(text: str, step: int = CHARS) -> Iterator[np.ndarray]:
    """Buckets of all features of one text, ``step`` code points at a time: all
    together those that ``features`` gives. A step hands the next one the hash
    and length of the word it ends in, its last words and last code points, so
    what is held is bounded also for a text without white space."""
    before, last = np.full(1, 32, np.uint64), np.zeros(0, np.uint64)
    begun, size = 0, 0
    for at in range(0, len(text) + 1, step):
        part = text[at : at + step] + (" " if at + step > len(text) else "")
        cps = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
        c = np.where(blank, np.uint32(32), cps).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * np.cumprod(np.full(len(c), _P, np.uint64)))])
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(c), _P_INVERSE, np.uint64)]))
        edge = np.concatenate([[True], blank, [True]])
        starts, ends = np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])
        words, sizes = (sums[ends] - sums[starts]) * inverse[starts], ends - starts
        if size and not blank[0]:
            words[0] = (begun + int(words[0]) * pow(int(_P), size, 1 << 64)) % (1 << 64)
            sizes[0] += size
        elif size:
            words, sizes = np.concatenate([np.array([begun], np.uint64), words]), np.concatenate([[size], sizes])
        begun, size = 0, 0
        if not blank[-1]:
            begun, size = int(words[-1]), int(sizes[-1])
            words = words[:-1]
        yield _bucket(words, WORD_BUCKETS)
        known, words = len(last), np.concatenate([last, words])
        for k, far in enumerate(AGAIN):
            new = max(far, known)
            again = np.count_nonzero(words[new:] == words[new - far : max(len(words) - far, new - far)])
            yield np.full(again, WORD_BUCKETS + GRAM_BUCKETS + k, np.int32)
        last = words[-max(AGAIN) :]
        known, c = len(before), np.concatenate([before, c])
        for buckets, there, length in _grams(c):
            yield buckets[there + length > known]
        before = c[1 - max(GRAMS) :]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """-> (buckets, number of the document) of all features of all texts:
    words are runs of anything but ASCII white space, character n-grams cover a
    word and at most one space on either side."""
    joined = " " + "".join(t + " " for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    doc = np.concatenate([doc[:1], doc]) if len(doc) else np.zeros(1, np.int32)
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    c = np.where(blank, np.uint32(32), cps).astype(np.uint64)
    # a word's hash: sum of c[i] p^i over it, divided by p^start, all modulo 2^64
    power = np.cumprod(np.full(len(c), _P, np.uint64))
    sums = np.cumsum(c * power)
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    inverse = np.cumprod(np.full(len(c), _P_INVERSE, np.uint64))
    words = (sums[ends - 1] - sums[starts - 1]) * inverse[starts - 1]
    ids, docs = [_bucket(words, WORD_BUCKETS)], [doc[starts]]
    for k, far in enumerate(AGAIN):
        again = np.flatnonzero((words[far:] == words[:-far]) & (docs[0][far:] == docs[0][:-far]))
        ids.append(np.full(len(again), WORD_BUCKETS + GRAM_BUCKETS + k, np.int32))
        docs.append(docs[0][again])
    for buckets, there, _ in _grams(c):
        ids.append(buckets)
        docs.append(doc[there + 1])
    return np.concatenate(ids), np.concatenate(docs)


def _groups(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts together up to CHARS code points; a longer one comes alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    """``vectors`` (buckets x dim), ``weights`` (dim x 2), ``bias`` (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def votes(self) -> np.ndarray:
        """What a feature adds to the score's logit: the softmax of two classes is linear in the mean."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 5) -> Model:
    """Stochastic gradient descent over (buckets, counts, class) of documents.
    Without documents, or with one class alone, the score tends to that class."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = -(-steps // len(rows)) if rows else 0
    for epoch in range(epochs):
        for at, k in enumerate(rng.permutation(len(rows))):
            ids, counts, label = rows[k]
            step = rate * (1 - (epoch + at / len(rows)) / epochs)
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = share @ e[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = w @ p
            w -= step * np.outer(mean, p)
            b -= 0.1 * step * p
            e[ids] -= step * VECTOR_RATE * np.outer(share, back)
    return Model(e, w, b)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """(doc_id, text), (doc_id, quality) -> the model, learned from about
    ``train_docs`` labelled rows that are not held out. Rows without a text or
    a label of 0 or 1 teach nothing."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    n = max(1, known.count())
    u = F.shiftrightunsigned(F.xxhash64(F.lit("train"), "doc_id"), 11) / F.lit(float(1 << 53))
    known = known.filter(u < train_docs / n)
    rows = docs.filter("text is not null").select("doc_id", "text").join(known, "doc_id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, label, doc) in enumerate(zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("doc_id").to_pylist())):
                counts = np.zeros(BUCKETS, np.int64)
                for found in long_features(text.as_py()):
                    counts += np.bincount(found, minlength=BUCKETS)
                ids = np.flatnonzero(counts).astype(np.int32)
                counts = counts[ids]
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([label], pa.int32()), pa.array([ids], pa.list_(pa.int32())),
                                                  pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "label", "ids", "counts"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [r for b in batches for r in b.itertuples(index=False)]
        got.sort(key=lambda r: (r.doc_id, r.label, len(r.ids)))
        m = train([(np.asarray(r.ids), np.asarray(r.counts), r.label) for r in got])
        yield pd.DataFrame({"vectors": [m.vectors.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias.tobytes()]})

    sampled = rows.mapInArrow(featurize, "doc_id bigint, label int, ids array<int>, counts array<int>")
    made = sampled.repartition(1).mapInPandas(learn, "vectors binary, weights binary, bias binary").collect()
    if not made:
        return train([])
    part = [np.frombuffer(bytes(x), np.float32) for x in made[0]]
    return Model(part[0].reshape(-1, DIM), part[1].reshape(DIM, 2), part[2])


def score(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of class 1 (null and empty texts: that of the bias alone)."""
    votes = spark.sparkContext.broadcast(model.votes())  # one number a bucket
    bias = float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = votes.value
        for batch in batches:
            logits = []
            for texts in _groups(t.as_py() or "" for t in batch.column(text)):
                if len(texts) == 1 and len(texts[0]) > CHARS:
                    found = [(len(ids), table[ids].sum(dtype=np.float64)) for ids in long_features(texts[0])]
                    n, total = map(sum, zip(*found))
                    logits.append(np.array([total / max(n, 1) + bias]))
                    continue
                ids, doc = features(texts)
                n = np.bincount(doc, minlength=len(texts))
                logits.append(np.bincount(doc, weights=table[ids], minlength=len(texts)) / np.maximum(n, 1) + bias)
            z = np.concatenate(logits) if logits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*batch.schema.names, "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
