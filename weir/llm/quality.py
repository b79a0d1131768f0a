"""A quality classifier of subword embeddings.

Each word, each of its character 3- and 4-grams between word marks, and each pair of words that follow each other owns a learned vector in a
hashed table; a pair of one word twice has a bucket of its own. A document's vector is the mean over all these features; a softmax over it gives the class. Both are fitted by stochastic gradient descent in numpy on
the driver, from a bounded sample of labelled rows. Since the mean and the softmax's input are linear, a feature's part in the
score is one number: a worker keeps the sum of its features for each word, and adds up words and pairs in arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import GOLDEN, Known, byte_buffer, mix, per_text, span_bytes, span_hashes, tidied, word_spans
from weir.llm.labelled import fold, sample

#: Rows of the labelled sample, at most.
TRAIN_ROWS = 4000
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 6, 0.4
#: Words whose sums a worker keeps, about.
REMEMBERED = 500_000
GRAMS = (3, 4)
#: The bucket of a word that follows itself.
AGAIN = 0


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _pairs(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of pairs of following words in one text, and the number of pairs before each text, with that of all at the end."""
    inside = np.ones(max(0, len(h) - 1), bool)
    cut = ends[1:-1]
    inside[cut[(cut > 0) & (cut < len(h))] - 1] = False
    at = np.flatnonzero(inside)
    found = np.where(h[at] == h[at + 1], AGAIN, _bucket(h[at] * GOLDEN + mix(h[at + 1]))) if len(at) else np.zeros(0, np.int64)
    return found, np.searchsorted(at, np.maximum(ends - 1, 0)) if len(h) else np.zeros(len(ends), np.int64)


def word_features(words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of all its character n-grams, one word after the other, and the number of each one's."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the word's end
    buckets, owners = [_bucket(h)], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        gram = np.full(len(at), n, np.uint64)
        for k in range(n):
            gram = gram * GOLDEN + points[at + k]
        buckets.append(_bucket(gram))
        owners.append(owner[at])
    flat, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(words))


@dataclass
class Model:
    parts: np.ndarray  # each feature's part in the difference of the two classes' inputs
    bias: float

    def scorer(self):
        """A function from texts to their scores; a worker has one for all its batches."""
        known = Known()
        sums, sizes = np.zeros(0), np.zeros(0)

        def score(texts: pa.Array) -> np.ndarray:
            nonlocal sums, sizes
            if known.n > REMEMBERED:
                known.forget()
                sums, sizes = np.zeros(0), np.zeros(0)
            raw, start, ends = word_spans(texts, lower=False)
            h = span_hashes(raw, start)
            word = known.find(h)
            if (new := np.flatnonzero(word < 0)).size:
                fresh, first = np.unique(h[new], return_index=True)
                flat, n = word_features(span_bytes(raw, start, byte_buffer(texts)[1][1:], new[first]), fresh)
                sums = np.append(sums, np.add.reduceat(self.parts[flat].astype(np.float64), np.cumsum(n) - n))
                sizes = np.append(sizes, n)
                known.add(fresh)
                word[new] = known.find(h[new])
            pair, pair_ends = _pairs(h, ends)
            upto = lambda values, at: np.concatenate([[0.0], np.cumsum(values)])[at]
            total = np.diff(upto(sums[word], ends)) + np.diff(upto(self.parts[pair].astype(np.float64), pair_ends))
            n = np.diff(upto(sizes[word], ends)) + np.diff(pair_ends)
            return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -40, 40)))

        return score


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares of its features."""
    one = pa.array([text], pa.string())
    raw, start, ends = word_spans(one, lower=False)
    h = span_hashes(raw, start)
    words, first, times = np.unique(h, return_index=True, return_counts=True)
    flat, n = word_features(span_bytes(raw, start, byte_buffer(one)[1][1:], first), words) if len(words) else (np.zeros(0, np.int64), times)
    counts = np.bincount(flat, np.repeat(times, n), BUCKETS) + np.bincount(_pairs(h, ends)[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1.0, counts.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    return fit_bags(list(map(bag, texts)), labels, seed)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """The fitted model; the same rows in the same order give the same one. With no rows, or one class only, it is constant."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((labels.count(1) + 1) / (labels.count(0) + 1))))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.zeros(BUCKETS, bool)
    for at, _ in bags:
        seen[at] = True
    y = np.array(labels, np.int64)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, n = bags[k]
            if not len(at):
                continue
            mean = n @ table[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p * 0.1
            # The mean spreads a gradient over all features; its usual step is scaled up by their effective number.
            table[at] -= (rate * min(50.0, 1 / float(n @ n)) * n)[:, None] * back
    # A feature that no labelled row has says nothing.
    return Model(np.where(seen, table @ (out[1] - out[0]), 0).astype(np.float32), float(bias[1] - bias[0]))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


BAGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled rows outside the held-out fold. The driver gets their features, 8 bytes for each of at most BUCKETS of a row, and no texts."""

    def run(batches) -> Iterator[dict]:
        for b in batches:
            found = [bag(x) for x in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "label": b.column("label"), "at": [at.tobytes() for at, _ in found], "n": [n.tobytes() for _, n in found]}

    got = per_text(sample(docs, labels, "quality", fold(3) != 1, rows), run, BAGS, rows=64).toPandas().sort_values("doc_id")
    return fit_bags([(np.frombuffer(a, np.int32), np.frombuffer(n, np.float32)) for a, n in zip(got["at"], got["n"], strict=True)], got["label"].tolist())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text); null and empty texts get the bias alone."""

    def run(batches) -> Iterator[dict]:
        score = model.scorer()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = score(b.column("text"))
            yield {"doc_id": ids, "held_out": [zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1 for i in ids], "score": found, "predicted": (found >= 0.5).astype(np.int32)}

    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their columns, that the model doesn't reject.

    Null and empty texts are judged by the bias alone; rows that repeat are judged alike; extra columns may have any names.
    """

    def run(batches):
        score = model.scorer()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(score(part.column("text")) >= 0.5))

    return docs.mapInArrow(lambda batches: tidied(__name__, run(batches)), docs.schema)
