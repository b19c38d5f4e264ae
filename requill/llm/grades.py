"""Ordinal regression of document quality: cumulative links over hashed text.

P(grade >= k) = sigmoid(w . x - threshold_k): one set of weights shared by all
grades, thresholds in order. Features are hashed pieces of a text's distinct
words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requill.llm.common import CACHE_WORDS, cut, texts

#: Weights of the model; its size doesn't depend on the data.
BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on at most, by default.
SAMPLE = 16_000
#: Buckets of the sample's documents that come to the driver at most, four bytes each: long texts fill it with fewer documents.
BUDGET = 24_000_000
#: A bucket counts if at least one in so many of the sample's documents has it, and three do: a part of the fit, so it follows the sample's size, not the corpus's.
RARE = 500
MARKS = b".,;:!?\"'()[]{}#*$%&|<>-_=+/\\~@^`"


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word: itself without marks in lower case, its first four bytes, its marks, and its being all upper case."""
    core = word.strip(MARKS)
    plain = core.lower()
    names = [b"w" + plain, b"p" + plain[:4], b"s" + word[len(word.rstrip(MARKS)) :]]
    if core.isupper() and len(core) > 1:
        names.append(b"u")
    return tuple(xxhash.xxh64_intdigest(x) % BUCKETS for x in names)


@dataclass
class OrdinalModel:
    """Weights and thresholds; ``p_at_least(score)[k - 1]`` is P(grade >= k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def p_at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[None, :] - self.thresholds[:, None], -50, 50)))

    @classmethod
    def fit(cls, features: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 12, rate: float = 0.05, decay: float = 1e-3, seed: int = 0) -> OrdinalModel:
        """AdaGrad on the likelihood of P(grade = k) = P(>= k) - P(>= k + 1); thresholds are kept in order, and rare buckets at 0."""
        found = np.zeros(BUCKETS, np.int64)
        for x in features:
            found[np.unique(x)] += 1
        common = found >= max(3, len(features) // RARE)
        features = [x[common[x]] for x in features]
        w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
        t = np.linspace(-1.0, 1.0, levels - 1) if levels > 2 else np.zeros(1)
        gt = np.full(levels - 1, 1e-6)
        rng = np.random.default_rng(seed)
        some = [i for i in range(len(features))]
        for _ in range(epochs if some else 0):
            order = rng.permutation(len(some))
            for start in range(0, len(order), 64):
                rows = order[start : start + 64]
                x = [features[i] for i in rows]
                size = np.array([len(a) for a in x])
                flat = np.concatenate(x) if size.sum() else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(rows)), size)
                score = np.bincount(row, w[flat], len(rows))
                y = grades[rows]
                p = np.vstack((np.ones(len(rows)), 1 / (1 + np.exp(-np.clip(score[None, :] - t[:, None], -50, 50))), np.zeros(len(rows))))
                d = p * (1 - p)
                at = np.arange(len(rows))
                mass = np.maximum(p[y, at] - p[y + 1, at], 1e-9)
                slope = (d[y, at] - d[y + 1, at]) / mass  # of the log-likelihood by the score
                g = np.bincount(flat, slope[row], BUCKETS)
                used = np.flatnonzero(g)
                gw[used] += g[used] ** 2
                w[used] += rate * g[used] / np.sqrt(gw[used]) - rate * decay * w[used]
                push = np.zeros(levels + 1)
                np.add.at(push, y, -d[y, at] / mass)
                np.add.at(push, y + 1, d[y + 1, at] / mass)
                gt += push[1:-1] ** 2
                t += rate * push[1:-1] / np.sqrt(gt)
                t = np.maximum.accumulate(t)
        return cls(w.astype(np.float32), t)


def featured(frame: DataFrame, columns: str) -> DataFrame:
    """``features`` (buckets of distinct words) beside ``columns`` (all long) of a frame with ``text``."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text")).cast(pa.binary())
            rows = [[f for w in set((text[i].as_py() or b"").split()) for f in word_features(w)] for i in range(batch.num_rows)]
            kept = [batch.column(batch.schema.names.index(k)) for k in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.int32()))], names=[*names, "features"])

    return frame.mapInArrow(run, ", ".join(f"{k} long" for k in names) + ", features array<int>")


def train(documents: DataFrame, labels: DataFrame, grade: Column, levels: int, sample: int = SAMPLE, budget: int = BUDGET) -> OrdinalModel:
    """A model fitted on at most ``sample`` labelled documents, those first by a hash of their id, and at most ``budget`` buckets of them.

    Labels without an id or grade, or of documents that aren't there, are
    passed over; with none at all every score is 0. The sizes of the sample's
    documents come to the driver first, then the buckets of those that fit.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("long").alias("grade")).dropna().distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = cut(featured(texts(documents).join(F.broadcast(chosen), "doc_id"), "doc_id grade").withColumn("place", F.xxhash64("doc_id")))
    sizes = rows.groupBy("place").agg(F.sum(F.size("features")).alias("n")).orderBy("place").toArrow()
    fit = np.cumsum(sizes.column("n").to_numpy()) <= budget
    if not fit.all():
        rows = rows.where(F.col("place") < int(sizes.column("place").to_numpy()[~fit][0]))
    rows = rows.select("doc_id", "grade", "features").toArrow()
    order = np.lexsort((rows.column("grade").to_numpy(), rows.column("doc_id").to_numpy()))
    features, grades = rows.column("features"), rows.column("grade").to_numpy()
    return OrdinalModel.fit([features[int(i)].values.to_numpy() for i in order], grades[order], levels)


def grade_documents(documents: DataFrame, labels: DataFrame, grade: Column, levels: int, keep_level: int, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Grade every document: doc_id, score, expected_grade, p_keep and kept.

    ``grade`` is a column over ``labels`` with values from 0 to ``levels`` - 1.
    ``p_keep`` is the tail probability P(grade >= ``keep_level``), and kept
    says whether it is at least ``threshold``. Null or empty texts score 0. One
    row per input row; repeated rows get equal grades, a null doc_id stays
    null, extra columns are ignored, an empty table gives no rows. Without
    usable labels nothing is known and all score 0.

    The model, of BUCKETS weights, is broadcast; documents are not shuffled.
    """
    model = train(documents, labels, grade, levels, sample)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected_grade", pa.float64()), ("p_keep", pa.float64()), ("kept", pa.bool_())])

    class Scores(dict):
        def __init__(self, weights: np.ndarray) -> None:
            super().__init__()
            self.weights = weights

        def __missing__(self, word: bytes) -> float:
            if len(self) >= CACHE_WORDS:
                self.clear()
            buckets = word_features(word)
            out = self[word] = sum(float(self.weights[b]) for b in buckets)
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        known = Scores(own.weights)
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            score = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                score[i] = math.fsum(map(known.__getitem__, set((text[i].as_py() or b"").split())))
            p = own.p_at_least(score)
            keep = p[keep_level - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(p.sum(0)), pa.array(keep), pa.array(keep >= threshold)], schema=schema)

    return texts(documents).mapInArrow(run, "doc_id long, score double, expected_grade double, p_keep double, kept boolean")
