"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

A text's features are the distinct hashes of its words, neighbouring pairs
and pairs with one word between them, letters A-Z folded and outer marks
dropped. Features of the labelled sample are made in parallel; the learner
itself reads that bounded sample in one task, several times over, with a rate
per coordinate and L1 shrinkage. Its non-zero weights, at most one per hash
slot, are sent to all tasks, which score whole texts.

Cases: a null or wordless text scores the intercept alone; ids whose labels
are null or contradict each other teach nothing; without both labels every
score is the share of label 1 seen (0 without any); repeated rows are scored
each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces, split_words, word_hashes
from .near_dedup import ODD

BITS = 20
MARKS = ".,;:!?\"'()[]{}*$%&#|<>-_"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of all texts, flat, and where each text's features start."""
    words, starts = split_words(texts, lower=True)
    trimmed = pc.utf8_trim(words.dictionary, characters=MARKS)
    w = word_hashes(pa.DictionaryArray.from_arrays(words.indices, trimmed))
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys, owner = [mixed(w * ODD[0])], [text]
    for gap in (1, 2):
        if len(w) > gap:
            same = text[:-gap] == text[gap:]
            keys.append(mixed(w[:-gap] * ODD[1] + w[gap:] * ODD[2] + np.uint64(gap))[same])
            owner.append(text[:-gap][same])
    slot = np.concatenate(keys) & np.uint64((1 << BITS) - 1)
    flat = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(BITS)) | slot)
    return (flat & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(flat, np.arange(len(starts), dtype=np.uint64) << np.uint64(BITS))


class Ftrl:
    """Follow the regularised leader, one coordinate at a time."""

    def __init__(self, l1: float, alpha: float = 2.0, beta: float = 1.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last slot is the intercept

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, x: np.ndarray, y: float) -> None:
        at = np.append(x, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        if abs(g) < 1e-4:
            return
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            flat, bounds = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), pa.ListArray.from_arrays(bounds.astype(np.int32), flat.astype(np.int32))],
                ["doc_id", "toxic", "x"])


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, x = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            y += b.column("toxic").to_pylist()
            x += [v.values.to_numpy() for v in b.column("x")]
        # Sums of gradients of useless features grow with the root of the rows; so does the shrinkage.
        model = Ftrl(l1=0.1 * np.sqrt(len(ids)))
        order = np.argsort(mixed(np.array(ids, np.int64).view(np.uint64) * ODD[3]), kind="stable")
        for epoch in range(epochs):
            for i in order if epoch % 2 == 0 else order[::-1]:
                model.learn(x[i], y[i])
        w = model.weights(slice(None))
        slots = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(w[slots])], ["slot", "weight"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, epochs: int = 4) -> np.ndarray:
    """Weights by hash slot, learned from at most about ``rows`` labelled documents."""
    own = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi").select("doc_id", "toxic")
    n = own.count()
    if not n:
        return np.zeros((1 << BITS) + 1)
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / n)))
    sample = docs.select("doc_id", "text").join(own, "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")
    made = sample.mapInArrow(_sample, "doc_id long, toxic int, x array<int>")
    learned = made.repartition(1).mapInArrow(_train(epochs), "slot long, weight double").collect()  # one row per slot at most
    out = np.zeros((1 << BITS) + 1)
    for r in learned:
        out[r["slot"]] = r["weight"]
    return out


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        slots, values = weights.value
        w[slots] = values
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, bounds = features(part.column("text"))
                sums = np.concatenate([[0.0], np.cumsum(w[flat])])
                z = w[-1] + sums[bounds[1:]] - sums[bounds[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``."""
    w = train(docs, labels, **options)
    slots = np.flatnonzero(w)
    weights = docs.sparkSession.sparkContext.broadcast((slots, w[slots]))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(weights), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
