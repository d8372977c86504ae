"""Toxicity: a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed to BUCKETS. Its score is
bias + sum of term weights + sum over pairs of terms of the product of their factors, so
a pair such as an insult with the mention of a group counts for more, or less, than both
apart. The pair sum takes one pass over the terms: half of (sum of factors) squared less
the sum of their squares.

Training sees at most TRAIN_DOCS labelled documents, whole, picked by a hash of their
id; every term in MIN_DOCS of them at least has a weight and factors. Terms whose own share
doesn't differ between the two labels by MIN_Z standard errors start with a long record of
past steps and shrink more: rare ones hardly move, or a vocabulary of hundreds of thousands
would be learned by heart, while frequent ones still learn what a pair of them tells. Scoring
sees every term of every document, a chunk of documents at a time.

Defined cases: a null or empty text has no terms and the bias' score; a null doc_id is
scored but never trained on or held out; repeated rows are scored alike; without labels
of both kinds every score is 0.5; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.learning import TRAIN_BYTES, Adam, fold, sampled_labels, sigmoid

FOLDS, HELD_OUT = 3, 1
TRAIN_DOCS, MIN_DOCS, MIN_Z = 8000, 3, 4.0
#: Bytes of all training documents' distinct terms together, four bytes each.
TRAIN_TOTAL = 1 << 28
BUCKETS = 1 << 20
FACTORS, EPOCHS, BATCH = 4, 45, 256
#: Starting sums of squared slopes and shrinkage, for weights and for factors: of telling terms, and of all others. With EPOCHS picked by
#: a split inside the permitted rows (tests/llm/tune_toxicity.py) among those that learn a pair of neutral terms.
TELLING, NEUTRAL = ((1e-8, 1e-8), (1e-6, 1e-5)), ((0.3, 0.1), (1e-4, 1e-4))
THRESHOLD = 0.7

#: Terms are runs of letters and of bytes outside ASCII.
_SEPARATOR = ~T.lookup([*range(65, 91), *range(97, 123), *range(128, 256)])


def terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, distinct term buckets end to end) chunk by chunk."""
    for w in T.words(column, lower=True, separators=_SEPARATOR):
        bucket = w.hashes & np.uint64(BUCKETS - 1)
        pairs = np.sort(w.row_of().astype(np.uint64) << np.uint64(32) | bucket)
        if len(pairs):
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        row = (pairs >> np.uint64(32)).astype(np.int64)
        yield w.row0, np.searchsorted(row, np.arange(w.rows + 1)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x over rows' ranges; an empty range is 0."""
    out = np.zeros((len(first) - 1, *x.shape[1:]))
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(x, first[:-1][some], axis=0)
    return out


def margins(bias: float, weight: np.ndarray, factor: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of documents whose terms are at places ``at``, with their sums of factors and each term's factors."""
    v = factor[at]
    s = _sums(v, first)
    return bias + _sums(weight[at], first) + 0.5 * (s * s - _sums(v * v, first)).sum(axis=1), s, v


@dataclass
class Machine:
    """``known`` are the buckets with weights, in order; their weights and factors, and the bias."""

    known: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: np.ndarray
    trained: bool = False

    def places(self, bucket: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents' known terms by place, and their offsets."""
        at = np.minimum(np.searchsorted(self.known, bucket), max(0, len(self.known) - 1))
        hit = self.known[at] == bucket if len(self.known) else np.zeros(len(bucket), bool)
        kept = np.concatenate([[0], np.cumsum(hit)])
        return at[hit], kept[first]

    def score(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(first) - 1, 0.5)
        return sigmoid(margins(self.bias[0], self.weight, self.factor, *self.places(bucket, first))[0])


def telling(bucket: np.ndarray, first: np.ndarray, label: np.ndarray, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> np.ndarray:
    """The buckets whose share of documents differs between the labels by ``min_z`` standard errors."""
    known, place = np.unique(bucket, return_inverse=True)
    each = np.repeat(label, np.diff(first))
    there, with_1 = np.bincount(place, minlength=len(known)), np.bincount(place, each, len(known))
    n, n_1 = len(label), label.sum()
    share = there / n
    error = np.sqrt(share * (1 - share) * (1 / n_1 + 1 / (n - n_1))) + 1e-9
    z = (with_1 / n_1 - (there - with_1) / (n - n_1)) / error
    return known[(there >= min_docs) & (np.abs(z) >= min_z)]


def train(bucket: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Fit on documents' distinct buckets, end to end by ``first``, with adaptive steps on mini-batches."""
    rng = np.random.default_rng(3)
    share = label.mean() if len(label) else 0.0
    known, docs = np.unique(bucket, return_counts=True)
    known = known[docs >= MIN_DOCS] if 0.0 < share < 1.0 else np.zeros(0, np.int64)
    model = Machine(known, np.zeros(len(known)), 0.01 * rng.standard_normal((len(known), FACTORS)), np.zeros(1))
    if not 0.0 < share < 1.0:
        return model
    model.bias[0] = np.log(share / (1 - share))
    at, off = model.places(bucket, first)
    adam = Adam([model.bias], 0.02)
    tells = np.isin(known, telling(bucket, first, label))
    pace_w, pace_v = (np.where(tells, own, other) for own, other in zip(TELLING[0], NEUTRAL[0], strict=True))
    pace_v = np.repeat(pace_v[:, None], FACTORS, axis=1)
    shrink_w, shrink_v = (np.where(tells, own, other) for own, other in zip(TELLING[1], NEUTRAL[1], strict=True))
    order = rng.permutation(len(label))
    batches = []
    for i in range(0, len(order), BATCH):
        rows = order[i : i + BATCH]
        n = off[rows + 1] - off[rows]
        own = np.concatenate([[0], np.cumsum(n)])
        there, local = np.unique(at[np.repeat(off[rows] - own[:-1], n) + np.arange(own[-1])], return_inverse=True)
        batches.append((label[rows], n, own, there, local))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            y, n, own, there, local = batches[k]
            weight, factor = model.weight[there], model.factor[there]
            margin, s, v = margins(model.bias[0], weight, factor, local, own)
            slope = (sigmoid(margin) - y) / len(y)
            adam.step([np.array([slope.sum()])])
            if not len(there):
                continue
            each = np.repeat(slope, n)
            pull = each[:, None] * (np.repeat(s, n, axis=0) - v)
            g_w = np.bincount(local, each, len(there)) + shrink_w[there] * weight
            g_v = np.column_stack([np.bincount(local, pull[:, f], len(there)) for f in range(FACTORS)]) + shrink_v[there, None] * factor
            pace_w[there] += g_w * g_w
            pace_v[there] += g_v * g_v
            model.weight[there] = weight - 0.4 * g_w / np.sqrt(pace_w[there])
            model.factor[there] = factor - 0.05 * g_v / np.sqrt(pace_v[there])
    model.trained = True
    return model


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row0, first, bucket in terms(b.column("text")):
            rows = len(first) - 1
            body = [bucket[first[i] : first[i + 1]].astype("<i4").tobytes() for i in range(rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row0, rows), b.column("label").slice(row0, rows), pa.array(body, pa.binary())], ["doc_id", "label", "terms"])


@dataclass
class Sample:
    """Labelled documents: ids, distinct buckets end to end by ``first``, labels."""

    doc_id: np.ndarray
    bucket: np.ndarray
    first: np.ndarray
    label: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Sample:
    """At most ``train_docs`` labelled documents outside the held-out fold, of TRAIN_BYTES at most each and TRAIN_TOTAL in all."""
    ids = sampled_labels(labels, "toxic", fold(F.col("doc_id"), FOLDS) == HELD_OUT, train_docs)
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = short.join(F.broadcast(ids), "doc_id")  # at most train_docs pairs of numbers
    found = rows.mapInArrow(_sample_rows, "doc_id long, label long, terms binary").groupBy("doc_id").agg(F.min(F.struct("label", "terms")).alias("v"))
    # The driver gets no more than TRAIN_TOTAL bytes of terms; sizes are at most train_docs numbers.
    size = F.octet_length("v.terms").cast("long")
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = found.withColumn("_upto", upto).filter(F.col("_upto") <= TRAIN_TOTAL).orderBy("doc_id").select("doc_id", "v.*").collect()
    each = [np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in got]
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    return Sample(np.array([r["doc_id"] for r in got], np.int64), np.concatenate(each) if each else np.zeros(0, np.int64), first, np.array([r["label"] for r in got], float))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """The machine of the ``sample`` of labelled documents."""
    found = sample(docs, labels, train_docs)
    return train(found.bucket, found.first, found.label)


def _scores(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(bucket, first) for _, first, bucket in terms(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select("doc_id", "text").mapInArrow(_scores(fit(docs, labels, train_docs)), "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
