"""Quality classifier: a linear-chain CRF over a document's lines.

Every line is good or bad. Features of the line and of its neighbours give the states'
scores, a transition matrix ties consecutive lines, and forward-backward gives each line's
marginal. A document's quality is the mean marginal weighted by line length, mapped to a
probability by a logistic fit.

Labels exist for documents only. Lines of good documents count as good; in a bad
document a plain classifier of single lines, fitted first, says which lines are bad, at
least its worst one. The chain is then trained on these line labels.

Training sees at most TRAIN_DOCS labelled documents, whole, picked by a hash of their
id; scoring sees every line of every document. A task holds a chunk of documents.

Defined cases: a null or blank text has no lines and quality 0; lines without words are
left out; a null doc_id is scored but never trained on or held out; repeated rows
are scored alike; without labels of both kinds every score is 0.5; an empty table
gives an empty result; other columns are carried by ``keep_good`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.learning import TRAIN_BYTES, Adam, fold, logistic, sampled_labels, sigmoid
from chatlake.llm.scratch import free_names

FOLDS, HELD_OUT = 5, 0
TRAIN_DOCS = 3000
THRESHOLD = 0.3
EPOCHS = 80
#: Own and neighbouring lines' features, each as it is and squared.
LINE_FEATURES = 13

_BREAK = T.lookup([0x0A])
_UPPER = T.lookup(range(65, 91))
_LETTER = T.lookup([*range(65, 91), *range(97, 123)])
_DIGIT = T.lookup(range(48, 58))
_STOP = T.lookup(map(ord, ".,;:?"))
_BANG = T.lookup([ord("!")])
_BAR = T.lookup([ord("|")])
_MARK = T.lookup(map(ord, "#$%&*+/<=>@\\^_`{}~[]"))


def _per(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=total[1:])
    return (total[ends] - total[starts]).astype(float)


def line_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, offsets of rows among lines, lengths in bytes, features) chunk by chunk."""
    for w in T.words(column):
        starts, ends, _ = T.runs(~_BREAK[w.data], w.offsets)
        at = np.searchsorted(w.starts, starts)
        n = np.searchsorted(w.starts, ends) - at
        starts, ends, at, n = starts[n > 0], ends[n > 0], at[n > 0], n[n > 0]
        row = np.searchsorted(w.first, at, "right") - 1
        first = np.searchsorted(row, np.arange(w.rows + 1))
        size = (ends - starts).astype(float)
        if not len(n):
            yield w.row0, first, size, np.zeros((0, LINE_FEATURES))
            continue
        line = np.repeat(np.arange(len(n)), n)
        h = w.hashes
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        pair = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.append(True, pair[1:] != pair[:-1])
        distinct = np.bincount((pair[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(n))
        whole = T.span_hash(h, at, at + n)
        key = T.mix(whole ^ T.mix(row.astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        prev = np.append(False, (key[1:] == key[:-1]))
        letters = _per(_LETTER, w.data, starts, ends)
        features = np.column_stack(
            [
                np.log1p(size),
                np.log1p(n),
                _per(_UPPER, w.data, starts, ends) / (letters + 1),
                _per(_MARK, w.data, starts, ends) / size,
                _per(_BANG, w.data, starts, ends) / size,
                _per(_BAR, w.data, starts, ends) / n,
                _per(_DIGIT, w.data, starts, ends) / size,
                np.bincount(line, again, len(n)) / n,
                1 - distinct / n,
                size / n,
                _per(_STOP, w.data, starts, ends) / size,
                prev,
                count[which] > 1,
            ]
        )
        yield w.row0, first, size, features


def in_context(raw: np.ndarray, first: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features of each line, with those of the lines before and after it in its document."""
    x = np.clip((raw - mean) / scale, -5, 5)
    x = np.column_stack([x, np.minimum(x * x, 9.0)])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = 0
    after[np.append(heads[1:], len(x))[: len(heads)] - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x))])


class Steps:
    """Lines of many documents by their place in the document, so that chains advance together."""

    def __init__(self, first: np.ndarray) -> None:
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        self.begin, lengths = first[:-1][order], n[order]
        self.active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")

    def forward_backward(self, score: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of each line (bad, good), expected transitions, and marginals of first lines.

        ``score`` is the log-potential of (bad, good) per line, in log space throughout.
        """
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        for t, n in enumerate(self.active):
            at = self.begin[:n] + t
            if t == 0:
                alpha[at] = score[at] + start
            else:
                prev = alpha[at - 1]
                alpha[at] = score[at] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
        for t in range(len(self.active) - 2, -1, -1):
            at = self.begin[: self.active[t + 1]] + t
            ahead = score[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
        both = alpha + beta
        norm = np.logaddexp(both[:, 0], both[:, 1])
        marginal = np.exp(both - norm[:, None])
        moves = np.zeros((2, 2))
        for t in range(1, len(self.active)):
            at = self.begin[: self.active[t]] + t
            ahead = score[at] + beta[at] - norm[at][:, None]
            for i in range(2):
                for j in range(2):
                    moves[i, j] += np.exp(alpha[at - 1, i] + move[i, j] + ahead[:, j]).sum()
        return marginal, moves, marginal[self.begin].sum(axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    calibration: np.ndarray | None

    def marginals(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        if not len(raw):
            return np.zeros(0)
        score = np.zeros((len(raw), 2))
        score[:, 1] = in_context(raw, first, self.mean, self.scale) @ self.weights
        return Steps(first).forward_backward(score, self.start, self.move)[0][:, 1]

    def quality(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean marginal of each document, weighted by line length."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.bincount(row, size, len(first) - 1)
        return np.bincount(row, size * self.marginals(raw, first), len(first) - 1) / np.maximum(weight, 1)

    def score(self, quality: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(quality), 0.5)
        return sigmoid(_logit(quality) * self.calibration[0] + self.calibration[1])


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def line_labels(x: np.ndarray, first: np.ndarray, label: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 for lines taken as good: all of good documents, and in bad ones those that a classifier of single lines likes."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    y = label[row].astype(float)
    weights = logistic(x[:, :-1], y, 1e-2)
    p = sigmoid(x[:, :-1] @ weights[:-1] + weights[-1])
    base = y.mean()
    good = np.where(label[row] == 1, True, p > max(0.5, base))
    for d in np.flatnonzero((label == 0) & (np.diff(first) > 0)):
        own = slice(first[d], first[d + 1])
        if good[own].all():
            good[first[d] + int(np.argmin(p[own]))] = False
    return good.astype(float)


def train(raw: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit the chain on lines of labelled documents, end to end in ``raw`` by ``first``."""
    width = 6 * LINE_FEATURES + 1
    mean, scale = (raw.mean(axis=0), raw.std(axis=0) + 1e-6) if len(raw) else (np.zeros(LINE_FEATURES), np.ones(LINE_FEATURES))
    model = Model(mean, scale, np.zeros(width), np.zeros(2), np.zeros((2, 2)), None)
    has = np.diff(first) > 0
    if len(set(label[has].tolist())) < 2:
        return model
    x = in_context(raw, first, mean, scale)
    good = line_labels(x, first, label, size)
    steps = Steps(first)
    heads = first[:-1][has]
    want_start = np.array([(good[heads] == 0).sum(), (good[heads] == 1).sum()], float)
    inner = np.ones(len(raw), bool)
    inner[heads] = False
    later = np.flatnonzero(inner)
    want_moves = np.zeros((2, 2))
    np.add.at(want_moves, (good[later - 1].astype(int), good[later].astype(int)), 1)
    adam = Adam([model.weights, model.start, model.move], 0.1)
    for _ in range(epochs):
        score = np.zeros((len(raw), 2))
        score[:, 1] = x @ model.weights
        marginal, moves, begins = steps.forward_backward(score, model.start, model.move)
        n = len(raw)
        adam.step([x.T @ (marginal[:, 1] - good) / n + 1e-3 * model.weights, (begins - want_start) / n + 1e-3 * model.start, (moves - want_moves) / n + 1e-3 * model.move])
    q = model.quality(raw, first, size)
    model.calibration = logistic(_logit(q)[:, None], label.astype(float))
    return model


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row0, first, size, raw in line_features(b.column("text")):
            rows = len(first) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(row0, rows),
                    b.column("label").slice(row0, rows),
                    pa.array([size[first[i] : first[i + 1]].astype("<f8").tobytes() for i in range(rows)], pa.binary()),
                    pa.array([raw[first[i] : first[i + 1]].astype("<f4").tobytes() for i in range(rows)], pa.binary()),
                ],
                ["doc_id", "label", "size", "raw"],
            )


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model of at most ``train_docs`` labelled documents outside the held-out fold, of TRAIN_BYTES at most each."""
    ids = sampled_labels(labels, "quality", fold(F.col("doc_id"), FOLDS) == HELD_OUT, train_docs)
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = short.join(F.broadcast(ids), "doc_id")  # at most train_docs pairs of numbers
    # One text for an id, so that the sample stays bounded where ids repeat.
    lines = rows.mapInArrow(_sample_rows, "doc_id long, label long, size binary, raw binary")
    found = lines.groupBy("doc_id").agg(F.min(F.struct("label", "size", "raw")).alias("v")).orderBy("doc_id").select("v.*").collect()
    size = [np.frombuffer(r["size"]) for r in found]
    raw = [np.frombuffer(r["raw"], np.float32).reshape(-1, LINE_FEATURES).astype(float) for r in found]
    first = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    label = np.array([r["label"] for r in found], int)
    return train(np.concatenate(raw) if raw else np.zeros((0, LINE_FEATURES)), first, np.concatenate(size) if size else np.zeros(0), label)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            scores = [model.score(model.quality(raw, first, size)) for _, first, size, raw in line_features(b.column(names.index("text")))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names) - 1)), pa.array(scores)], names)

    return run


def scored(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with the score ``name`` as its last column."""
    rows = docs.withColumn(name, F.lit(0.0))
    return rows.mapInArrow(_scores(model), rows.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, train_docs))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without those scored below ``threshold``."""
    (name,) = free_names(docs.columns, "_score")
    return scored(docs, fit(docs, labels, train_docs), name).filter(F.col(name) >= threshold).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
