"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (of low quality) and 2 (good). One weight vector over hashed text features is shared by all
thresholds: P(grade <= k) = sigmoid(threshold_k - w x), with thresholds kept in order. Features are the distinct words
of a text and their last three bytes (which catch glued-on symbols and casing), hashed to DIMENSIONS cells. Only cells
that go with a grade beyond chance in the sample get a weight.

The model is fitted on a bounded sample: the MAX_RATED rated documents with the least hash of their id, found through
a broadcast of their ids; about 2 KB of features each reach the driver, MAX_BYTES in all (documents beyond are left out
of the sample, in order of another hash). Every document is then scored in one pass. It
is kept if the tail probability P(grade >= 2) reaches THRESHOLD.

Defined cases: a null or empty text has no feature and gets the model's prior; rows with a null ``doc_id`` are scored
but not learnt from; of several ratings of a document the lowest counts, of several texts one;  without ratings every document is of the
middle grade's prior and is kept; an empty table gives an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelake.llm import textkernel as tk
from ratelake.llm.common import cut, hash_sample, table

DIMENSIONS = 1 << 16
MAX_RATED = 16_000
#: Bytes of features that the driver collects at most.
MAX_BYTES = 1 << 27
SEED = 5
GRADES = 3
THRESHOLD = 0.5
#: A cell gets a weight if its documents' mean grade lies so many standard errors from the overall mean.
LEAST_Z = 4.0
_EPOCHS, _BATCH, _RATE, _DECAY = 60, 128, 0.05, 1e-3


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one fewer than grades

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the last grade; shape (n, grades - 1)."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def features(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature cells of each text, text after text, and where each text's begin (one more entry at the end)."""
    start, end, first = c.words()
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    prefix = c.prefix()
    words = tk.span_hashes(prefix, start, end, tk.POWERS)
    tails = tk.mix(tk.span_hashes(prefix, np.maximum(start, end - 3), end, tk.POWERS) ^ np.uint64(0x2545F4914F6CDD1D))
    cells = np.concatenate([words, tails]) % np.uint64(DIMENSIONS)
    keys = np.unique(np.concatenate([text, text]) * DIMENSIONS + cells.astype(np.int64))
    return keys % DIMENSIONS, np.searchsorted(keys, np.arange(len(first), dtype=np.int64) * DIMENSIONS)


def _scores(weights: np.ndarray, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    return tk.per_text(at, weights[cells])


def telling(grades: np.ndarray, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which cells go with a grade beyond chance; the others would only be learnt by heart."""
    n = np.bincount(cells, minlength=DIMENSIONS)
    away = np.bincount(cells, np.repeat(grades - grades.mean(), np.diff(at)), DIMENSIONS)
    return np.abs(away) >= LEAST_Z * (grades.std() + 1e-9) * np.sqrt(np.maximum(n, 1))


def grade_of() -> Column:
    quality, toxic = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    return F.when(toxic > 0, 0).when(quality < 1, 1).otherwise(2)


def rated_sample(labels: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """(doc_id, grade) of at most ``max_rated`` rated documents, by hash of the id."""
    rated = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade_of()).alias("grade"))
    return hash_sample(rated, "doc_id", max_rated, seed=SEED)


def rated_features(docs: DataFrame, rated: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades and features (cells, starts) of the rated documents; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column(0)):
                cells, at = features(c)
                blobs = [cells[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column(1).slice(c.lo, c.hi - c.lo), batch.column(2).slice(c.lo, c.hi - c.lo), pa.array(blobs, pa.binary())], names=["doc_id", "grade", "cells"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rated), "doc_id").select("text", "doc_id", "grade")
    # One row for each rated id, whatever number of rows share it, and in order of the sample's hash what fits the budget.
    found = own.mapInArrow(run, "doc_id long, grade int, cells binary").groupBy("doc_id", "grade").agg(F.min("cells").alias("cells"))
    found = cut(found.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id")))
    upto = F.sum(F.octet_length("cells")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # the sample's rows only
    fitting = found.select("doc_id", "place", F.octet_length("cells").alias("size"), upto.alias("upto")).where(F.col("upto") <= MAX_BYTES)
    rows = found.join(F.broadcast(fitting.select("doc_id")), "doc_id").orderBy("doc_id").select("grade", "cells").collect()
    cells = [np.frombuffer(r["cells"], "<u4").astype(np.int64) for r in rows]
    at = np.concatenate([[0], np.cumsum([len(x) for x in cells])]).astype(np.int64)
    return np.array([r["grade"] for r in rows], np.int64), np.concatenate([*cells, np.zeros(0, np.int64)]), at


def fit(grades: np.ndarray, cells: np.ndarray, at: np.ndarray, grades_n: int = GRADES) -> OrdinalModel:
    """Maximum likelihood by Adam over shuffled batches in a fixed order; deterministic."""
    if not len(grades):
        return OrdinalModel(np.zeros(DIMENSIONS), -1.0 - np.arange(grades_n - 1, 0, -1, dtype=float))
    share = np.clip([np.mean(grades > k) for k in range(grades_n - 1)], 0.01, 0.99)
    cuts = np.sort(-np.log(share / (1 - share)))
    weights, chosen = np.zeros(DIMENSIONS), telling(grades, cells, at)
    at = np.concatenate([[0], np.cumsum(chosen[cells])])[at]
    cells = cells[chosen[cells]]
    moments = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(grades_n - 1), np.zeros(grades_n - 1)]
    order, step = np.random.default_rng(7), 0
    for epoch in range(_EPOCHS):
        rate = _RATE * (1 - epoch / _EPOCHS)
        shuffled = order.permutation(len(grades))
        for lo in range(0, len(grades), _BATCH):
            rows = shuffled[lo : lo + _BATCH]
            size = at[rows + 1] - at[rows]
            ends = np.cumsum(size)
            own = cells[np.repeat(at[rows] - (ends - size), size) + np.arange(int(ends[-1]))]
            score = np.diff(np.concatenate([[0.0], np.cumsum(weights[own])])[np.concatenate([[0], ends])])
            model = OrdinalModel(weights, cuts)
            above = np.concatenate([np.ones((len(rows), 1)), model.tail(score), np.zeros((len(rows), 1))], axis=1)
            k, i = grades[rows], np.arange(len(rows))
            slope = above * (1 - above)
            p = np.maximum(above[i, k] - above[i, k + 1], 1e-9)
            by_score = -(slope[i, k] - slope[i, k + 1]) / p / len(rows)
            by_cut = np.zeros((len(rows), grades_n + 1))
            by_cut[i, k] += slope[i, k] / p / len(rows)
            by_cut[i, k + 1] -= slope[i, k + 1] / p / len(rows)
            slopes = [np.bincount(own, np.repeat(by_score, size), DIMENSIONS) + _DECAY * weights, by_cut[:, 1:-1].sum(axis=0)]
            step += 1
            for j, (value, g) in enumerate(zip((weights, cuts), slopes)):
                m, v = moments[2 * j], moments[2 * j + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            cuts = np.maximum.accumulate(cuts)
    return OrdinalModel(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> OrdinalModel:
    return fit(*rated_features(docs, rated_sample(labels, max_rated)))


def score(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_good (tail probability of the best grade), kept."""
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch.column(1)):
                tail = OrdinalModel(weights, cuts).tail(_scores(weights.astype(np.float64), *features(c)))
                yield pa.record_batch([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= threshold)], names=["doc_id", "expected_grade", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_good double, kept boolean")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
