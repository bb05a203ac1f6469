"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

The grades are 0 (poor), 1 (sound but toxic) and 2 (sound). One vector of hashed-text weights w is shared by
ordered thresholds t1 < t2, with P(grade >= k) = sigmoid(w.x - t_k). The expected grade is the sum of the tail
probabilities; a document is kept if P(grade >= 2) reaches KEEP.

It is fitted on at most LABELLED_ROWS labelled rows (see hashed.py) on the driver and judges every document
whole. Without usable labels nothing is known and everything is kept with even odds.

Cases: a null text is empty; a null id stays; repeated rows each give a row; an empty table gives an empty
result; null labels are left out of the fit; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_names, sound, table
from .hashed import LABELLED_ROWS, Buckets, Sample, Weights, labelled_sample, vector

GRADES = 3
KEEP = 0.5
#: Labelled documents that share a bucket and standard errors of it that are asked here (see hashed.SHARED); LASSO
#: draws the weights of what is left to 0.
SHARED, ERRORS, LASSO = 5, 7, 3e-4


def grade(quality: int, toxic: int) -> int:
    return 0 if quality <= 0 else 1 if toxic > 0 else 2


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and thresholds of the cumulative link."""

    def __init__(self, weights: Weights, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: str, buckets: Buckets) -> np.ndarray:
        """P(grade >= k) for k = 1, 2."""
        idx, value = vector(text, buckets)
        return _sigmoid(self.weights.score(idx, value) - self.thresholds)


def fit(sample: Sample, y: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4, lasso: float = LASSO) -> Ordinal:
    """Maximum likelihood by Adam; rare grades weigh in more than their number of rows."""
    if len(set(y.tolist())) < 2:
        return Ordinal(Weights(np.empty(0, int), np.empty(0)), np.zeros(GRADES - 1))
    sample, buckets = sample.select(y, SHARED, ERRORS)
    weights, gaps = np.zeros(sample.size), np.array([0.0, 0.0])
    weight = row_weights(y)
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, gaps)]
    for step in range(1, rounds + 1):
        _, rises = likelihood(sample, y, weight, weights, gaps, ridge)
        for value, rise, m in zip((weights, gaps), rises, memory, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * rise
            m[1] = 0.99 * m[1] + 0.01 * rise * rise
            pace = rate / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            value += pace * (m[0] / (1 - 0.9**step))
            if value is weights:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - pace * lasso, 0)
    return Ordinal(Weights(buckets, weights), _ordered(gaps))


def row_weights(y: np.ndarray) -> np.ndarray:
    """Of each row, in all 1: rare grades weigh in more than their number of rows."""
    have = np.bincount(y, minlength=GRADES)
    share = np.where(have > 0, len(y) / np.maximum(1, have), 0) ** 0.5
    return share[y] / share[y].sum()


def likelihood(sample: Sample, y: np.ndarray, weight: np.ndarray, weights: np.ndarray, gaps: np.ndarray, ridge: float) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """(weighted log likelihood less the ridge, its gradient by the weights and by what gives the thresholds)."""
    n = sample.rows
    at = np.arange(n)
    tail = np.c_[np.ones(n), _sigmoid(sample.scores(weights)[:, None] - _ordered(gaps)), np.zeros(n)]
    p = np.maximum(tail[at, y] - tail[at, y + 1], 1e-9)
    slope = tail * (1 - tail)  # of each tail by the score
    by_score = weight * (slope[at, y] - slope[at, y + 1]) / p
    by_threshold = np.array([(weight / p * slope[:, k] * ((y == k - 1) * 1.0 - (y == k))).sum() for k in (1, 2)])
    value = float(weight @ np.log(p)) - ridge * float(weights @ weights) / 2
    return value, (sample.pull(by_score) - ridge * weights, np.array([by_threshold.sum(), by_threshold[1] * _sigmoid(gaps[1])]))


def _ordered(gaps: np.ndarray) -> np.ndarray:
    return np.array([gaps[0], gaps[0] + np.log1p(np.exp(gaps[1]))])


def fitted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Ordinal:
    sample = labelled_sample(docs, labels, ["quality", "toxic"], [], rows, stems=True)
    return fit(sample, np.array([grade(q, t) for q, t in sample.labels], dtype=int))


_NAMES = ["p_sound", "p_clean", "expected_grade"]


def judged(docs: DataFrame, model: Ordinal, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs and after them p_sound, p_clean and expected_grade, under names that are free in docs."""
    read, *made = free_names(docs, "__text", *["__" + n for n in _NAMES])
    rows = docs.select(*columns, sound(text_col).alias(read))
    out_fields, text_at = rows.schema.fields[:-1], len(columns)
    names = [*columns, *made]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(stems=True)
        for batch in batches:
            tails = np.array([model.tails(x.as_py() or "", buckets) for x in batch.column(text_at)]).reshape(-1, GRADES - 1)
            arrays = [*batch.columns[:text_at], pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = StructType([StructField(f.name, f.dataType) for f in out_fields] + [StructField(n, DoubleType()) for n in names[len(out_fields) :]])
    return rows.mapInArrow(each, schema)


def grade_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, p_sound, p_clean, expected_grade, kept) of every document."""
    out = judged(docs, fitted(docs, labels), ["doc_id"]).toDF("doc_id", *_NAMES)
    return out.withColumn("kept", F.col("p_clean") >= keep)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns."""
    out = judged(docs, fitted(docs, labels), docs.columns)
    return out.where(F.col(out.columns[-2]) >= keep).select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
