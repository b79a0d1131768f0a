"""Toxic passages by maximum-scoring segments.

A token is a run of word characters. A term is a token or a beginning of one, which stands for its inflected forms, and in runs of more than LONG characters, as of scripts
without spaces, also every four characters that follow each other. A term's score is its log-odds between toxic
and other labelled documents, each count smoothed by a Dirichlet prior in proportion to the term's share of the whole
corpus. A token scores as its best term; tokens whose log-odds are within their error score a small loss. A linear scan (Ruzzo and Tompa) finds every maximal scoring segment of a document. Under the other documents' token shares
segment scores have an extreme-value tail (Karlin and Altschul): K n exp(-lambda S) segments of score S or more are expected
in n tokens. The document's evidence is the chance of all its segments under that tail, and a logistic curve, fitted on the same
labelled rows, turns it into the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import Known, Scratch, byte_buffer, per_text, span_bytes, span_hashes, word_spans
from weir.llm.labelled import fold, sample

#: Rows of the labelled sample, at most.
TRAIN_ROWS = 8000
#: The prior's documents, the least log-odds and their least multiple of the error, and what any other token scores.
PRIOR, LEAST, LEAST_Z, LOSS = 20.0, 2.0, 3.0, 0.25
#: Characters of a run that is a term as a whole; words that a worker remembers, about.
LONG, REMEMBERED = 40, 500_000
RUN = re.compile(r"\w+")


def terms(word: str) -> tuple[str, ...]:
    """Each run of the word with its beginnings of 3 to 8 characters; of a run longer than LONG all its grams of four characters instead of itself."""
    out: list[str] = []
    for t in RUN.findall(word.lower()):
        if len(t) <= LONG:
            out.append(f"={t}")
        else:
            out += [f"~{t[i : i + 4]}" for i in range(len(t) - 3)]
        out += [t[:k] for k in range(3, min(9, len(t) + 1))]
    return tuple(dict.fromkeys(out))


class WordScores:
    """What a function of words gives for each word of texts, kept for words that were met; `make` maps a list of words to an array."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make, self.known = make, Known()
        self.values = make([])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words, one text after the other, and the number of words before each text, with that of all at the end."""
        if self.known.n > REMEMBERED:
            self.known.forget()
            self.values = self.make([])
        raw, start, ends = word_spans(texts, lower=True)
        h = span_hashes(raw, start)
        word = self.known.find(h)
        if (new := np.flatnonzero(word < 0)).size:
            fresh, first = np.unique(h[new], return_index=True)
            words = [w.decode("utf-8", "replace") for w in span_bytes(raw, start, byte_buffer(texts)[1][1:], new[first])]
            self.values = np.append(self.values, self.make(words))
            self.known.add(fresh)
            word[new] = self.known.find(h[new])
        return self.values[word], ends


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), left to right, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def sparse_segments(at: np.ndarray, sums: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """segments() where only the tokens at `at` score above zero; the losses between two of them are taken at once."""
    flat: list[float] = []
    places: list[int] = []
    last = 0.0
    for i in at.tolist():
        flat += [float(sums[i] - scores[i] - last), float(scores[i])]
        places += [i, i]
        last = float(sums[i])
    return [(places[a], places[b - 1] + 1, s) for a, b, s in segments(flat)]


@dataclass
class Model:
    scores: dict[str, float]
    decay: float  # lambda of the extreme-value tail
    factor: float  # its K
    slope: float
    level: float

    def evidence(self, scores: list[float] | np.ndarray, n: int) -> float:
        """-log10 of the chance of the document's segments of these scores, 0 without any, 30 at most."""
        total = np.maximum(0.0, self.decay * np.asarray(scores, float) - np.log(max(self.factor * n, 1e-12))).sum()
        return min(30.0, float(total) / np.log(10))

    def scorer(self):
        """A function from texts to (score, segments) of each; a worker has one for all its batches."""
        best = lambda w: max((self.scores[t] for t in terms(w) if t in self.scores), default=-LOSS)
        cache = WordScores(lambda words: np.array([best(w) for w in words], float))

        def score(texts: pa.Array) -> list[tuple[float, list[tuple[int, int, float]]]]:
            flat, ends = cache.of(texts)
            out = []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                each = flat[i:j]
                at = np.flatnonzero(each > 0)
                found = sparse_segments(at, np.cumsum(each), each) if len(at) else []
                x = self.level + self.slope * self.evidence([s for _, _, s in found], j - i)
                out.append((float(1 / (1 + np.exp(-np.clip(x, -40, 40)))), found))
            return out

        return score


def log_odds(toxic: dict[str, int], clean: dict[str, int], corpus: dict[str, int], n_toxic: int, n_clean: int, n_corpus: int) -> dict[str, float]:
    """Scores of the terms, from counts of documents with them, whose log-odds exceed LEAST and LEAST_Z of their errors."""
    out = {}
    for w, y in toxic.items():
        a = PRIOR * (corpus.get(w, 0) + 1) / (n_corpus + 1)
        t, c = y + a, clean.get(w, 0) + a
        d = np.log(t / (n_toxic + PRIOR - t)) - np.log(c / (n_clean + PRIOR - c))
        if d / np.sqrt(1 / t + 1 / c) >= LEAST_Z and d >= LEAST:
            out[w] = float(d)
    return out


def tail(scores: dict[str, float], clean: dict[str, int], tokens: int) -> float:
    """lambda: where the mean of exp(lambda score) over the clean documents' tokens is 1."""
    shares = np.array([max(clean.get(w, 0), 0.5) / max(tokens, 1) for w in scores])
    s = np.array(list(scores.values()))
    rest = max(0.0, 1 - shares.sum())
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (low, mid) if (shares * np.exp(mid * s)).sum() + rest * np.exp(-mid * LOSS) > 1 else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton steps with a weak prior that keeps separable rows finite."""
    b = np.zeros(2)
    X = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        b += np.linalg.solve((X.T * (p * (1 - p))) @ X + 0.02 * np.eye(2), X.T @ (y - p) - 0.02 * b)
    return max(0.0, float(b[0])), float(b[1])


def _counts(df: DataFrame, keep: set[str] | None) -> DataFrame:
    """(term, label, rows): documents with each term, of all terms or of `keep`, counted in each task first. Term "" has the documents."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("rows", T.LongType())])

    def run(batches) -> Iterator[dict]:
        # A word is a group of terms; words of the same terms share it, and those of none are 0.
        groups: dict[tuple, int] = {(): 0}
        of = (lambda w: terms(w)) if keep is None else (lambda w: tuple(t for t in terms(w) if t in keep))
        cache = WordScores(lambda words: np.array([groups.setdefault(of(w), len(groups)) for w in words], np.int64))
        rows: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            found, ends = cache.of(b.column("text"))
            names = list(groups)
            for i, j, label in zip(ends[:-1].tolist(), ends[1:].tolist(), b.column("label").to_pylist(), strict=True):
                own = found[i:j]
                rows[label].update({t for k in np.unique(own[own > 0]).tolist() for t in names[k]})
                rows[label][""] += 1
            if len(groups) > REMEMBERED:
                groups.clear()
                groups[()] = 0
                cache.known.forget()
                cache.values = cache.make([])
        got = [(w, k, n) for k in rows for w, n in rows[k].items()]
        for i in range(0, len(got), 50_000):
            yield dict(zip(("term", "label", "rows"), map(list, zip(*got[i : i + 50_000], strict=True)), strict=True))

    return per_text(df, run, schema).groupBy("term", "label").agg(F.sum("rows").alias("rows"))


def _may_tell(n_toxic: int, n_clean: int) -> F.Column:
    """Whether a term's counts can reach LEAST and LEAST_Z at any share in the corpus: an upper bound of both on each of many ranges of the prior's weight.

    The log-odds fall with the weight and the error falls too, so on a range the one is taken at its low end and the other at its high end.
    """
    y, c = F.col("1").cast("double"), F.col("0").cast("double")
    edges = [0.0, *(PRIOR * 1.25**-k for k in range(60, -1, -1))]

    def reaches(low: float, high: float) -> F.Column:
        t, u = y + low, c + max(low, 1e-9)
        d = F.log(t / F.greatest(F.lit(n_toxic + PRIOR) - t, F.lit(1e-9))) - F.log(u / F.greatest(F.lit(n_clean + PRIOR) - u, F.lit(1e-9)))
        return (d >= LEAST) & (d >= LEAST_Z * F.sqrt(1 / (y + high) + 1 / (c + high)))

    found = F.lit(False)
    for low, high in zip(edges, edges[1:], strict=False):
        found = found | reaches(low, high)
    return (y > 0) & found


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns labels from at most `rows` rows outside the held-out fold, and the terms' shares from all of docs.

    The driver gets the counts of those terms that may tell toxic rows by the sample's counts, at most as many as the sample's toxic rows have, and the evidence of the sample's rows. Without toxic rows, or without
    terms that tell them, every document has the same low score.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.table(sample(docs, labels, "toxic", fold(5) != 0, rows))
    pivot = scratch.table(_counts(known.select("text", "label"), None).groupBy("term").pivot("label", [0, 1]).agg(F.sum("rows")).na.fill(0))
    n = pivot.where("term = ''").collect()
    n_clean, n_toxic = (n[0]["0"], n[0]["1"]) if n else (0, 0)
    likely = pivot.where("term <> ''").where(_may_tell(n_toxic, n_clean)).collect() if n_toxic else []
    toxic, clean = {r["term"]: r["1"] for r in likely}, {r["term"]: r["0"] for r in likely}
    none = Model({}, 1.0, 1.0, 0.0, -20.0)
    if not toxic:
        return none
    shares = {r["term"]: r["rows"] for r in _counts(docs.select("text", F.lit(0).alias("label")), set(toxic)).collect()}
    scores = log_odds(toxic, clean, shares, n_toxic, n_clean, shares.pop("", 0))
    if not scores:
        return none
    model = Model(scores, 1.0, 1.0, 1.0, 0.0)
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("best", T.ArrayType(T.DoubleType()))])

    def run(batches) -> Iterator[dict]:
        score = model.scorer()
        for b in batches:
            sizes = np.diff(word_spans(b.column("text"), lower=True)[2])
            yield {"label": b.column("label"), "n": sizes, "best": [sorted(s for _, _, s in found) for _, found in score(b.column("text"))]}

    got = per_text(known.select("text", "label"), run, schema).toPandas()
    low = got[got.label == 0]
    model.decay = tail(scores, clean, int(low.n.sum()))
    # K by moments: the segments that the clean rows have, against those expected of n tokens at the least score.
    least = min(scores.values())
    model.factor = (0.5 + sum(map(len, low.best))) / max(1.0, float(low.n.sum()) * float(np.exp(-model.decay * least)))
    order = np.lexsort((got.n, got.label))
    x = np.array([model.evidence(ss, n) for n, ss in zip(got.n, got.best, strict=True)])
    model.slope, model.level = logistic(x[order], got.label.to_numpy(float)[order])
    scratch.drop(known, pivot)
    return model


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.StringType())])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and passages (start:end:score in words, joined by commas) for each row of docs.

    Null and empty texts have no passages and the lowest score.
    """

    def run(batches) -> Iterator[dict]:
        score = model.scorer()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            got = score(b.column("text"))
            yield {
                "doc_id": ids, "held_out": [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids], "score": [s for s, _ in got],
                "predicted": [int(s >= 0.5) for s, _ in got], "passages": [",".join(f"{a}:{z}:{v:.3f}" for a, z, v in f) for _, f in got],
            }

    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
