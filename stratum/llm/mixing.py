"""Mixing sources to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of labelled documents, gives each document a posterior over domains, which are
sources unless another column is named. It sees hashed text and, as one more feature, the document's own domain where that is
known; half the labelled documents are shown without it, so that the text decides where it is not. With t_i its tokens and p_i its
posterior, a document adds a_i = t_i p_i to the expected domain totals. Rates x_i >= 0 are fitted so that sum x_i a_i meets the targets T.

They minimise f(x) = sum_d w_d (sum_i x_i a_id - T_d)^2 / 2 with w_d = 1 / T_d (bounded by FLOOR) by projected gradient from x = 1. Steps are measured by
tokens (a rate moves by p_i, not by a_i, so that long documents are not favoured), x <- max(0, y - eta p_i.g) with
g = w (sum y_i a_i - T), and eta is one over the largest eigenvalue of the D x D matrix sum t_i p_i p_i' w, with which a step
from y = x never raises f. y goes on beyond x as in accelerated gradients; whenever f rose that is given up for a step. The rates
returned are those of the lowest f met, and residual, in every row, is what their totals miss the targets by: sum |total - T| / sum T.

Only totals, two numbers for each domain, come to the driver after a pass. A rate is a function of p_i and of the steps so far,
so that no pass has to store rates: each recomputes them in numpy batches from the stored posteriors, and a lost executor costs a reread.

The targets are shares of budget times the tokens of all documents, so rates go below 1 where a domain has more than its share, down
to 0 for a domain whose share is 0. copies holds the rate as whole copies, its fraction decided by a hash of the id.

Cases: a null text has no tokens and keeps rate 1; a null id stays; repeated rows each give a row; labels or
domains that are null are left out of the fit; a domain without labelled documents gets posterior 0 and no
target; an empty table gives an empty result; other columns are kept if asked for, but one named like an added column is
replaced by it; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, sound, table
from .hashed import LABELLED_ROWS, Buckets, Sample, Weights, labelled_sample, tag, vector

#: Domains at most, where no targets name them: those with most labelled documents.
DOMAINS = 64
PASSES = 40
#: Residual at which passes end, and the share of f that PATIENCE passes have to take off for it to go on.
CLOSE, GAIN, PATIENCE = 1e-4, 1e-3, 6
#: A domain's misses weigh in by its target, or by this share of all targets if that is more.
FLOOR = 1e-2
#: The figure of a known domain beside those of the text.
TAG = 4.0


class Softmax:
    def __init__(self, weights: Weights, present: np.ndarray):
        """present: domains that labelled rows have; the others get posterior 0."""
        self.weights, self.present = weights, present

    def posterior(self, text: str, buckets: Buckets, known: int | None = None) -> np.ndarray:
        """known: the bucket of the domain that the document is known to have."""
        if not len(self.present):
            return np.empty(0)
        idx, value = vector(text, buckets)
        s = self.weights.score(idx, value)
        if known is not None:
            s = s + self.weights.score(np.array([known]), np.array([TAG]))
        if self.present.any():
            s = np.where(self.present, s, -np.inf)
        e = np.exp(s - s.max())
        return e / e.sum()


def fit(sample: Sample, y: np.ndarray, domains: int, rounds: int = 40, rate: float = 0.1, ridge: float = 1e-4) -> Softmax:
    """Multinomial logistic regression by Adam; y holds domain numbers. Domains without rows get no posterior."""
    if not sample.rows:
        return Softmax(Weights(np.empty(0, int), np.zeros((0, domains))), np.zeros(domains, bool))
    (sample, buckets), gold = sample.select(y), np.eye(domains)[y]
    w = np.zeros((sample.size, domains))
    absent = gold.sum(axis=0) == 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        s = np.stack([sample.scores(w[:, d]) for d in range(domains)], axis=1)
        s[:, absent] = -np.inf
        e = np.exp(s - s.max(axis=1, keepdims=True))
        miss = (gold - e / e.sum(axis=1, keepdims=True)) / sample.rows
        rise = np.stack([sample.pull(miss[:, d]) for d in range(domains)], axis=1) - ridge * w
        m = 0.9 * m + 0.1 * rise
        v = 0.99 * v + 0.01 * rise * rise
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Softmax(Weights(buckets, w), ~absent)


def shown(sample: Sample, names: list[str], y: np.ndarray) -> Sample:
    """The sample with the domain as a feature of every second document; documents stand by a hash of their id."""
    rows = np.arange(0, sample.rows, 2)
    out = Sample([], sample.labels)
    tags = np.array([tag(n) for n in names], dtype=np.int64)
    out.rows = sample.rows
    out.row, out.idx = np.r_[sample.row, rows], np.r_[sample.idx, tags[y[rows]]] if len(names) else sample.idx
    out.value = np.r_[sample.value, np.full(len(rows), TAG)]
    return out


def _posteriors(docs: DataFrame, columns: list[str], model: Softmax, names: list[str], domain_col: str, made: list[str]) -> DataFrame:
    """The columns with tokens and posterior of every document, under the two names made for them."""
    read, known = free_names(docs, "__text", "__domain")
    rows = docs.select(*columns, sound("text").alias(read), sound(F.col(domain_col).cast("string")).alias(known))
    n = len(columns)
    tags = {name: tag(name) for name in names}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(n)]
            tokens = pa.array([len(t.split()) for t in texts], pa.int64())
            soft = [model.posterior(t, buckets, tags.get(d)).tolist() for t, d in zip(texts, batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], tokens, pa.array(soft, pa.list_(pa.float64()))], names=[*columns, *made])

    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:n]]
    return rows.mapInArrow(each, T.StructType([*fields, T.StructField(made[0], T.LongType()), T.StructField(made[1], T.ArrayType(T.DoubleType()))]))


#: A step: eta times the gradient by domain, and how far y goes on beyond x after it.
Step = tuple[np.ndarray, float]


def rates(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of rows with these posteriors after the steps."""
    x = y = np.ones(len(p))
    for move, beyond in steps:
        before, x = x, np.maximum(0.0, y - p @ move)
        y = x + beyond * (x - before)
    return x, y


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def _summed(soft: DataFrame, size: int, sums) -> np.ndarray:
    """Sum over all rows (tokens, posterior) of what sums(tokens, posteriors) gives, size numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column(1), batch.num_rows)
                total += sums(batch.column(0).to_numpy(zero_copy_only=False).astype(float), p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in soft.mapInArrow(each, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def fit_rates(soft: DataFrame, shares: np.ndarray, budget: float = 1.0, passes: int = PASSES) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """(steps that give the rates, totals met, targets) from rows (tokens, posterior)."""
    d = len(shares)
    if not d:
        return [], shares, shares
    got = _summed(soft, d + d * d, lambda t, p: np.r_[t @ p, (p.T @ (t[:, None] * p)).ravel()])
    total, second = got[:d], got[d:].reshape(d, d)
    wanted = np.where(total > 1e-9 * max(total.sum(), 1e-9), shares, 0.0)
    if not total.sum() or not wanted.sum():
        return [], total, total
    target = budget * total.sum() * wanted / wanted.sum()
    w = 1 / np.maximum(target, FLOOR * target.sum())
    eta = 1 / np.linalg.eigvalsh(np.sqrt(w)[:, None] * second * np.sqrt(w)).max()
    steps: list[Step] = []
    at_y, pull, falls = total, 1.0, [(float(w @ (total - target) ** 2), 0, total)]
    for k in range(1, passes + 1):
        further = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        tried = [*steps, (eta * w * (at_y - target), (pull - 1) / further)]

        def sums(t: np.ndarray, p: np.ndarray, tried: list[Step] = tried) -> np.ndarray:
            x, y = rates(p, tried)
            return np.r_[(t * x) @ p, (t * y) @ p]

        got = _summed(soft, 2 * d, sums)
        f = float(w @ (got[:d] - target) ** 2)
        if f > falls[-1][0]:  # the next step is a plain one from here
            tried[-1] = (tried[-1][0], 0.0)
            got[d:], further = got[:d], 1.0
        steps, at_y, pull = tried, got[d:], further
        falls.append((f, k, got[:d]))
        if np.abs(got[:d] - target).sum() <= CLOSE * target.sum() or (k > PATIENCE and min(falls)[0] > (1 - GAIN) * min(falls[:-PATIENCE])[0]):
            break
    _, best, met = min(falls, key=lambda x: x[:2])
    return steps[:best], met, target


def mixture(
    docs: DataFrame, labels: DataFrame, columns: list[str], targets: dict[str, float] | None = None, domain_col: str = "source",
    budget: float = 1.0, rows: int = LABELLED_ROWS, domains: int = DOMAINS,
) -> DataFrame:
    """The columns of every document with n_tokens, posterior (domains in the order of targets, or else by name), rate, copies and residual.

    Without targets, the domains of labelled documents are to have equal shares."""
    known = docs.where(F.col(domain_col).isin(list(targets))) if targets else docs
    sample = labelled_sample(known, labels, [], [domain_col], rows)
    have = [str(d) for (d,) in sample.labels]
    if targets is None:
        often = sorted(set(have), key=lambda n: (-have.count(n), n))[:domains]
        targets = dict.fromkeys(sorted(often), 1.0)
    names = list(targets)
    place = {n: i for i, n in enumerate(names)}
    sample, y = sample.rows_where(np.array([n in place for n in have], bool)), np.array([place[n] for n in have if n in place], dtype=int)
    model = fit(shown(sample, names, y), y, len(names))
    made = free_names(docs, "__tokens", "__posterior")
    kept = [c for c in columns if c.lower() not in ("n_tokens", "posterior", "rate", "copies", "residual")]
    draw_id, fraction = free_names(docs, "__id", "__rate")
    carried = docs.withColumn(draw_id, F.xxhash64(F.lit("copies"), "doc_id"))
    soft = cut(_posteriors(carried, [*kept, draw_id], model, names, domain_col, made))
    steps, met, target = fit_rates(soft.select(*made), np.array([targets[n] for n in names], dtype=float), budget)
    residual = float(np.abs(met - target).sum() / target.sum()) if target.sum() else 0.0
    n, names_in = len(kept) + 1, soft.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column(n + 1), batch.num_rows)
                x = np.where(batch.column(n).to_numpy(zero_copy_only=False) > 0, rates(p, steps)[0], 1.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*names_in, fraction])

    schema = T.StructType([*soft.schema.fields, T.StructField(fraction, T.DoubleType())])
    draw = F.pmod(F.col(draw_id), F.lit(1 << 20)) / float(1 << 20)
    return soft.mapInArrow(each, schema).select(
        *kept,
        F.col(made[0]).alias("n_tokens"),
        F.col(made[1]).alias("posterior"),
        F.col(fraction).alias("rate"),
        (F.floor(fraction) + (draw < F.col(fraction) - F.floor(fraction)).cast("long")).alias("copies"),
        F.lit(residual).alias("residual"),
    )


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "source"])
