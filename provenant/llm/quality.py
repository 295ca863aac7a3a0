"""Quality classifier: Naive Bayes support vectors over n-grams of word shapes and words.

A document's features are indicators of the 1- to 3-grams of its words' shapes, where a shape keeps a word's
classes of letters, its digits and its other signs, and whether the word repeats the one before it, and of its words,
without regard to case. Indicators are scaled by the log ratio of their smoothed frequencies in the two classes, those that fewer than `LEAST_DOCUMENTS` of the rows
have by nothing; a linear hinge-loss model is fitted to
them by dual coordinate descent; its margins become scores by a sigmoid fitted to labelled rows that the descent
didn't see. The model is fitted to a bounded sample of labelled rows: `most_labelled`, those whose ids have the
smallest hashes, and of these as many in that order as have features of `most_bytes`; scoring reads every whole text and
needs no shuffle.

Defined results: a null or empty text has no features and gets the score of the bias; labels that are null or of no
document are left out; of several labels of a document the smallest counts; if labels of only one class are there,
all scores are that class's smoothed share. Other columns are ignored. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty, written
from .tokens import words_of

BITS = 18
#: A feature that fewer of the rows have tells nothing.
LEAST_DOCUMENTS = 5
_CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1\1+", re.S)


def shape_code(word: bytes) -> int:
    """A hash of the word's shape: Word -> Aaa, WORD!! -> AA!!, runs cut to two."""
    return zlib.crc32(_RUNS.sub(rb"\1\1", word.translate(_CLASSES)))


class Features:
    """text -> sorted distinct feature numbers below 2 ** BITS."""

    def __init__(self, remember: int = 300_000):
        self.shapes: dict[bytes, int] = {}
        self.remember = remember

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        shapes, distinct = self.shapes, set(words)
        new = [w for w in distinct if w not in shapes]
        if len(shapes) + len(new) > self.remember:
            shapes.clear()
            new = list(distinct)
        shapes.update((w, shape_code(w)) for w in new)
        same = [False, *(a == b for a, b in zip(words, words[1:], strict=False))]
        shape = np.array([shapes[w] for w in words], np.uint64) * np.uint64(2) + np.array(same, np.uint64)
        grams = [shape]
        for _ in range(2):
            grams.append(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[len(words) - len(grams[-1]) + 1 :] + np.uint64(1))
        grams.append(np.array([zlib.crc32(w.lower()) for w in distinct], np.uint64) + np.uint64(1 << 40))
        mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(mixed >> np.uint64(64 - BITS)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, least: int = LEAST_DOCUMENTS) -> np.ndarray:
    """Log of each feature's share among class 1's indicators over its share among class 0's; 0 for features of fewer
    than `least` rows."""
    counts = [np.full(1 << BITS, smoothing) for _ in range(2)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return np.where(counts[0] + counts[1] - 2 * smoothing >= least, ratios, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss linear model over scaled, length-normalised indicators: each dual variable
    in turn goes to its optimum within [0, cost], and the primal weights follow."""
    scaled = [(x, ratios[x] / max(1.0, np.linalg.norm(ratios[x]))) for x in rows]
    signs = np.where(labels > 0, 1.0, -1.0)
    squares = np.array([v @ v + 1.0 for _, v in scaled])
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        widest = 0.0
        for i in rng.permutation(len(rows)):
            x, v = scaled[i]
            slope = signs[i] * (weights[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost)
            if step := (new - alpha[i]) * signs[i]:
                weights[x] += step * v
                bias += step
                widest = max(widest, abs(step))
                alpha[i] = new
        if widest < 1e-4:
            break
    return weights, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method on the log loss with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x @ (p - target) + 1e-3 * np.array([a, 0])
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    """ratios * weights in one vector, for features that are counted once per document."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        margin = float(self.weights[x] @ r) / max(1.0, float(np.sqrt(r @ r))) + self.bias
        return 1 / (1 + math.exp(-min(max(self.slope * margin + self.offset, -30.0), 30.0)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Every fifth row is kept for the sigmoid."""
    share = float((labels.sum() + 1) / (len(labels) + 2))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, math.log(share / (1 - share)))
    apart = np.arange(len(rows)) % 5 == 0
    if len(set(labels[apart])) < 2 or len(set(labels[~apart])) < 2:
        seen, apart = np.ones(len(rows), bool), np.ones(len(rows), bool)
    else:
        seen = ~apart
    chosen, y = [x for x, s in zip(rows, seen, strict=True) if s], labels[seen]
    ratios = log_count_ratios(chosen, y)
    weights, bias = dual_coordinate_descent(chosen, y, ratios)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    margins = np.array([float(weights[x] @ ratios[x]) / max(1.0, float(np.linalg.norm(ratios[x]))) + bias for x, s in zip(rows, apart, strict=True) if s])
    model.slope, model.offset = sigmoid_fit(margins, labels[apart])
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_bytes: int = 200 << 20, held_out_fold: int | None = 0, folds: int = 5) -> Model:
    """A model of labels.quality from at most `most_labelled` labelled documents, with features of at most `most_bytes`
    in all, none of the held-out fold: those with crc32(doc_id as text) mod folds = held_out_fold."""
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    if held_out_fold is not None:
        label = label.where(fold_of(folds) != held_out_fold)
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "quality", "features"])

    found = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(featurise, "doc_id long, quality int, features binary")
    # of rows that share a doc_id, one
    rows = written(found.groupBy("doc_id").agg(F.min(F.struct("quality", "features")).alias("r")).select("doc_id", "r.*"), "quality-features")
    sizes = rows.select("doc_id", F.length("features").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `most_labelled` pairs of numbers
    total, chosen = 0, []
    for doc_id, n in sizes:
        total += n + 100
        if total > most_bytes:
            break
        chosen.append((doc_id,))
    if len(chosen) < len(sizes):
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    rows = sorted(tuple(r) for r in rows.toLocalIterator())
    return fit([np.frombuffer(r[2], "<u4").astype(np.int64) for r in rows], np.array([float(r[1]) for r in rows]))


def fold_of(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, held_out_fold: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`, and the columns in `carry`. A null doc_id isn't held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(astuple(model))
    names = [f"carry_{i}" for i in range(len(carry))]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Model(*shared.value)
        for batch in batches:
            scores = [model.score(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), *(batch.column(n) for n in names)], ["doc_id", "score", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)
    rated = rows.mapInArrow(rate, "doc_id long, score double" + kinds)
    held_out = F.coalesce(fold_of(folds) == held_out_fold, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])
