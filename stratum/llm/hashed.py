"""Hashed text features and bounded samples of labelled rows, shared by the two classifiers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sound

#: Hashed weights.
BUCKETS = 1 << 18
#: Labelled rows that a classifier is fitted on at most: those with the smallest hash of their id.
LABELLED_ROWS = 6000
#: Dense figures that stand before the hashed ones.
DENSE = 8
#: Words' buckets start here; shapes of words stand before.
WORDS = 1 << 10
#: A bucket gets a weight if so many labelled documents share it and its share of some label's documents differs
#: from that of the rest by so many standard errors (fewer in a small sample); others could only be learnt by heart.
SHARED, ERRORS = 8, 12
#: Letters of the two stems of a word, its beginnings if it is longer, and the share of a text's words from which a stem counts.
STEM, OFTEN = (4, 5), 0.01
_LETTERS = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """word -> bucket of the bare word and, 20 bits up, bucket of what stands around its letters; filled as words are met.

    With stems, vectors have them too.
    """

    def __init__(self, stems: bool = False):
        super().__init__()
        self.stems = Stems() if stems else None

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            out = _word(word.lower()) | _shape("A" if word.isupper() and len(word) > 1 else "a") << 20
        else:
            out = _word("".join(_LETTERS.findall(word)).lower()) | _shape(re.sub(r"[0-9]+", "9", _LETTERS.sub("a", word))[:12]) << 20
        if len(self) > 500_000:
            self.clear()
        self[word] = out
        return out


class Stems(dict):
    """word -> bucket of its short stem and, 20 bits up, of its long one, 0 if the word is no longer than it; filled as words are met."""

    def __missing__(self, word: str) -> int:
        low = word.lower() if word.isalpha() else "".join(_LETTERS.findall(word)).lower()
        if len(self) > 500_000:
            self.clear()
        short, long = (_word("\0" + low[:n]) if len(low) > n else 0 for n in STEM)
        self[word] = out = short | long << 20
        return out


def _word(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 11) % (BUCKETS - WORDS) + WORDS


def _shape(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 12) % (WORDS - DENSE) + DENSE


def tag(name: str) -> int:
    """The bucket of something known about a document besides its text."""
    return _word("\1" + name)


def vector(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: a few dense figures, the share of each shape, the words that occur
    and, if the buckets are made for it, the stems that make up more than OFTEN of the words.

    A text without words has the first dense figure only.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.array([0]), np.array([1.0])
    both = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    idx, counts = np.unique(np.r_[both & 0xFFFFF, both >> 20], return_counts=True)
    value = np.where(idx < WORDS, 4.0 * counts / n, 1.0)
    distinct = len(set(words)) / n
    plain = sum(map(str.isalpha, words)) / n
    dense = [0.0, distinct, plain, math.log1p(n) / 8, float(n < 20), float(distinct < 0.3), len(text) / n / 8, float(plain < 0.5)]
    if buckets.stems is not None:
        both = np.fromiter(map(buckets.stems.__getitem__, words), np.int64, n)
        stems, often = np.unique(np.r_[both & 0xFFFFF, both >> 20], return_counts=True)
        stems = stems[(stems > 0) & (often > OFTEN * n)]
        idx, value = np.r_[idx, stems], np.r_[value, np.ones(len(stems))]
    return np.r_[np.arange(DENSE), idx], np.r_[dense, value]


class Weights:
    """Weights of some buckets, a number or a row each; all others weigh nothing. Only those are sent to tasks."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray):
        self.buckets, self.values, self._place = buckets, values, None

    def __getstate__(self):
        return self.__dict__ | {"_place": None}

    def score(self, idx: np.ndarray, value: np.ndarray):
        """Sum of each bucket's weight times its value."""
        if self._place is None:
            self._place = np.full(BUCKETS, -1, np.int32)
            self._place[self.buckets] = np.arange(len(self.buckets))
        at = self._place[idx]
        has = at >= 0
        return value[has] @ self.values[at[has]]


class Sample:
    """Vectors of bounded many labelled documents, all their entries in a row."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[tuple]):
        self.rows, self.labels, self.size = len(vectors), labels, BUCKETS
        self.row = np.repeat(np.arange(self.rows), [len(i) for i, _ in vectors]) if vectors else np.empty(0, int)
        self.idx = np.concatenate([i for i, _ in vectors]) if vectors else np.empty(0, int)
        self.value = np.concatenate([v for _, v in vectors]) if vectors else np.empty(0)

    def select(self, y: np.ndarray, shared: int = SHARED, errors: float = ERRORS) -> tuple[Sample, np.ndarray]:
        """(this sample with the buckets alone that tell something of the labels y (numbers from 0), numbered anew; these buckets)."""
        n, per = self.rows, np.bincount(y)
        have = np.bincount(self.idx, minlength=BUCKETS)
        telling = have >= min(shared, max(1, n // 8))
        p = np.clip(have / max(n, 1), 1e-9, 1 - 1e-9)
        best = np.zeros(BUCKETS)
        for label in np.nonzero((per > 0) & (per < n))[0]:
            own = np.bincount(self.idx[y[self.row] == label], minlength=BUCKETS)
            error = np.sqrt(p * (1 - p) * (1 / per[label] + 1 / (n - per[label])))
            best = np.maximum(best, np.abs(own / per[label] - (have - own) / (n - per[label])) / error)
        telling &= best >= min(errors, 0.35 * math.sqrt(n))  # in a small sample no difference reaches many errors
        telling[:DENSE] = True
        pick = telling[self.idx]
        out = Sample([], self.labels)
        buckets = np.nonzero(telling)[0]
        out.rows, out.row, out.value, out.size = n, self.row[pick], self.value[pick], len(buckets)
        out.idx = (np.cumsum(telling) - 1)[self.idx[pick]]
        return out, buckets

    def rows_where(self, keep: np.ndarray) -> Sample:
        """This sample with some of its rows."""
        out = Sample([], [x for x, k in zip(self.labels, keep, strict=True) if k])
        pick, place = keep[self.row] if self.rows else np.empty(0, bool), np.cumsum(keep) - 1
        out.rows, out.row, out.idx, out.value = int(keep.sum()), place[self.row[pick]].astype(int), self.idx[pick], self.value[pick]
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.idx] * self.value, minlength=self.rows)

    def pull(self, by_row: np.ndarray) -> np.ndarray:
        """Sum of each row's vector times its number."""
        return np.bincount(self.idx, weights=by_row[self.row] * self.value, minlength=self.size)


def text_sample(rows: list[tuple], stems: bool = False) -> Sample:
    """Of (text, label...) rows."""
    buckets = Buckets(stems)
    return Sample([vector(t, buckets) for t, *_ in rows], [tuple(r) for _, *r in rows])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], doc_cols: list[str], rows: int = LABELLED_ROWS, stems: bool = False) -> Sample:
    """At most rows labelled documents, chosen by a hash of the id, so alike on every run: their whole texts as
    vectors, with the named columns of the labels and of the documents.

    Rows with a null among the id, the text and these columns are left out. The vectors are made on the executors;
    only the chosen ones come to the driver, as the classifier is fitted there.
    """
    known = labels.select(F.col("doc_id").alias("__id"), *[F.col(c).alias(f"__l_{c}") for c in label_cols]).dropna().distinct()
    chosen = known.orderBy(F.xxhash64("__id"), *known.columns).limit(rows)
    texts = docs.select("doc_id", sound("text").alias("__text"), *[F.col(c).alias(f"__d_{c}") for c in doc_cols]).dropna()
    names = [f"__l_{c}" for c in label_cols] + [f"__d_{c}" for c in doc_cols]
    picked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(*names, "__id", "__text")
    n = len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(stems)
        for batch in batches:
            made = [vector(x.as_py(), buckets) for x in batch.column(n + 1)]
            idx = pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary())
            value = pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], idx, value], names=[*names, "__id", "__idx", "__value"])

    fields = [T.StructField(f.name, f.dataType) for f in picked.schema.fields[: n + 1]]
    made = picked.mapInArrow(each, T.StructType([*fields, T.StructField("__idx", T.BinaryType()), T.StructField("__value", T.BinaryType())]))
    got = made.orderBy(F.xxhash64("__id"), "__id", "__idx", "__value").limit(rows).collect()
    vectors = [(np.frombuffer(r["__idx"], np.int32).astype(np.int64), np.frombuffer(r["__value"], np.float32).astype(float)) for r in got]
    return Sample(vectors, [tuple(r[c] for c in names) for r in got])
