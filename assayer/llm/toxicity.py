"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in the words it holds; a document's is the
noisy-or of its sentences, one minus the product of their complements.  Weights are learnt from document labels
alone, by gradient steps with an L1 step that leaves words without evidence at zero; afterwards the sentence
scores point at the offending sentences.

Words are runs of letters and digits with A-Z lower-cased; a word's features are itself and its beginnings of
four to eight letters, so that inflected forms share evidence.  Sentences end at . ! ? or a line break.  Null,
empty and blank texts count as one sentence without words.  Repeated rows get equal scores.  Without labels of
both kinds every score is 0.  Only id and text are read, never language, source or other columns; ids keep their type
and may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import by_hash

#: Labelled documents of each label to fit on, at most; features considered, at most; documents a feature must occur in.
FIT_ROWS, FEATURES, LEAST = 4000, 1500, 3
#: Words whose weight a worker keeps.
KEPT_WORDS = 300_000
THRESHOLD = 0.3

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 10 if c in b".!?\n" else 32 for c in range(256)
)


def sentences(text: str | None) -> list[bytes]:
    """Lower-cased sentences that hold a word; at least one, empty if need be."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")
    return [s for s in found if s.strip()] or [b""]


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a hyphen, which no word has."""
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:n].encode() + b"-" for n in (4, 5, 6, 7, 8) if len(letters) > n)]


class _Weights(dict):
    """Weight of each word seen so far, the sum of its features' weights."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


@dataclass(frozen=True)
class Model:
    """Feature weights and the bias of a sentence."""

    weights: dict[bytes, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in one task."""

    def __init__(self, model: Model):
        self.bias, self.words = model.bias, _Weights(model.weights)

    def sentences(self, text: str | None) -> np.ndarray:
        z = [self.bias + sum(map(self.words.__getitem__, set(s.split()))) for s in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 30)))

    def document(self, text: str | None) -> float:
        """Noisy-or; documents without any weighted word need no look at single sentences."""
        bare = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        if any(map(self.words.__getitem__, bare.split())):
            return float(-np.expm1(np.log1p(-np.minimum(self.sentences(text), 1 - 1e-12)).sum()))
        plain = sum(1 for s in bare.split(b"\n") if s.strip()) or 1
        return float(-np.expm1(-plain * np.log1p(np.exp(self.bias))))


def train(bags: list[tuple[int, int, list[list[int]]]], words: int, share: float, steps: int = 600, rate: float = 0.2, l1: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias from bags (label, plain sentences, feature numbers of the others); ``share``: of label 1.

    The bias stays between -9 and -3: a sentence without evidence is never certain, and hundreds of them still
    make an unlikely document.
    """
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    doc = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    rows = [s for b in bags for s in b[2]]
    sentence = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    word = np.array([w for s in rows for w in s], np.int64)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
    theta = np.r_[np.zeros(words), -6.0]
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for step in range(1, steps + 1):
        z = np.clip(theta[-1] + np.bincount(sentence, theta[word], len(rows)), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        quiet = np.bincount(doc, np.log1p(-p), len(y)) + plain * np.log1p(-p0)
        none = np.exp(quiet)
        slope = weight * np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        dz = slope[doc] * p
        grad = np.r_[np.bincount(word, dz[sentence], words), dz.sum() + (slope * plain).sum() * p0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        theta -= move
        shrink = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-6)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - shrink, 0)
        theta[-1] = np.clip(theta[-1], -9.0, -3.0)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, most_features: int = FEATURES) -> Model:
    """Fits on at most ``most`` documents of each label, taken by a hash of the id; ``labels``: (doc_id, y).

    Executors count words per label and turn sentences to word numbers; the driver gets at most ``most_features``
    features and the numbers that the sampled documents hold.
    """
    shares = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model({}, -40.0)
    chosen = by_hash(labels, most).checkpoint()
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), "y")), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {f for w in set(b" ".join(sentences(text)).split()) for f in features(w)}:
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))], ["word", "n0", "n1"])

    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("text", "y").mapInArrow(count, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (totals[0] + 1.0))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST).select("word", strength.alias("s")).orderBy(F.desc("s"), "word").limit(most_features).collect()
    number = {bytes(r["word"]): i for i, r in enumerate(best)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, held = [], []
            for text in batch.column(0).to_pylist():
                rows = [sorted(number[f] for w in set(s.split()) for f in features(w) if f in number) for s in sentences(text)]
                held.append([r for r in rows if r])
                plain.append(len(rows) - len(held[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(plain, pa.int64()), pa.array(held, pa.list_(pa.list_(pa.int32())))], ["y", "plain", "held"])

    rows = sample.select("text", "y").mapInArrow(bag, "y int, plain long, held array<array<int>>").collect()
    bags = sorted((r["y"], r["plain"], [list(s) for s in r["held"]]) for r in rows)
    if len({b[0] for b in bags}) < 2:
        return Model({}, -40.0)
    weights, bias = train(bags, len(number), shares[1] / (shares[0] + shares[1]))
    return Model({w: float(weights[i]) for w, i in number.items() if abs(weights[i]) > 1e-3}, bias)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, sentences) of every document.

    ``sentences``: numbers, from 0, of the sentences whose own score reaches the threshold.
    """

    @F.pandas_udf("score double, sentences array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for texts in batches:
            found = [scorer.document(t) for t in texts]
            # A document's score is at least that of each of its sentences.
            where = [np.flatnonzero(scorer.sentences(t) >= threshold).tolist() if p >= threshold else [] for t, p in zip(texts, found)]
            yield pd.DataFrame({"score": pd.Series(found, dtype="float64"), "sentences": pd.Series(where, dtype=object)})

    rows = docs.select(F.col(id_column).alias("doc_id"), run(text).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence, score, words): sentences, numbered from 0, whose own score reaches the threshold."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), *(T.StructField(n, k) for n, k in (("sentence", T.LongType()), ("score", T.DoubleType()), ("words", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentences(value)
                rows += [(doc_id, int(i), float(p), found[i].decode("utf-8", "replace").strip()) for i, p in enumerate(scorer.sentences(value)) if p >= threshold]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
