"""Language identification: prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ORDER bytes with the counts of the
bytes that followed them. A byte's code length is that of method C: in the longest known context,
a byte seen n times of N, with D different ones seen, costs -log2(n / (N + D)); an unseen one costs an
escape, -log2(D / (N + D)), and is coded in the next shorter context, where the bytes of the
longer one no longer count (exclusion), and at last evenly among the bytes never seen. So a context's
256 probabilities add up to 1. The language with the shortest code for the whole
text is predicted; the score is its share of 2 ** -length over all languages.

A text is read as if ORDER zero bytes stood before it, with A-Z lower-cased. A byte's cost
thus depends on a window of ORDER + 1 bytes alone: tasks count the windows of all learnable
texts and add them up before the shuffle, and Spark adds up the shorter strings from the
distinct windows. The statistics are frozen after that. The trees that every task gets are
bounded: a language keeps the strings seen at least so often that MODEL_NODES are left over
all languages (a string's endings are seen as often at least, so trees stay whole). Scoring
keeps windows' costs in a memo of fixed size, which changes no result.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, and so is
everything where nothing was learned; a null doc_id is scored, and learned from as it is in
no fold; repeated rows are learned from and scored alike; equal code lengths go to the
smallest language by code point; an empty table gives an empty result; other columns are not
carried. A text of any length is read in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.learning import fold

FOLDS, HELD_OUT = 4, 2
ORDER = 5
#: The most nodes of all languages' trees together; what tasks get is some 40 bytes a node.
MODEL_NODES = 1 << 21
UNKNOWN = "und"

#: Positions at a time, windows that a task gathers before it hands their counts on, and entries of the memo.
SEGMENT, GATHERED, MEMO = 1 << 18, 1 << 20, 1 << 21
_SYMBOLS = 256
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ABSENT = np.uint64(0xFFFFFFFFFFFFFFFF)


def _low(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first position of each, windows) of consecutive bytes of a column; a row may go on in the next segment."""
    data, off = T.raw(column)
    for a in range(0, len(data), SEGMENT):
        b = min(a + SEGMENT, len(data))
        body = np.zeros(ORDER + b - a, np.uint64)
        before = min(a, ORDER)
        body[ORDER - before :] = _FOLD[data[a - before : b]]
        window = np.zeros(b - a, np.uint64)
        for k in range(ORDER + 1):
            window = window << np.uint64(8) | body[k : k + b - a]
        lo, hi = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        begin = off[lo:hi]
        for k in range(ORDER):  # what stands before a text isn't part of it
            at = begin + k
            at = at[(at >= a) & (at < np.minimum(off[lo + 1 : hi + 1], b))] - a
            window[at] &= _low(k + 1)
        some = off[lo + 1 : hi + 1] > begin
        yield np.arange(lo, hi)[some], np.maximum(begin[some] - a, 0), window


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return key[heads], np.add.reduceat(count[order], heads) if len(heads) else count[:0]


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, window, n) of (text, lang), each pair once for every GATHERED distinct ones."""
    languages: dict[str, int] = {}
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def flushed():
        names = pa.array(list(languages), pa.string())
        key, count = _added(keys, counts)
        for a in range(0, len(key), SEGMENT):
            part = key[a : a + SEGMENT]
            which = pa.array((part >> np.uint64(48)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([names.take(which), pa.array((part & _low(ORDER + 1)).astype(np.int64)), pa.array(count[a : a + SEGMENT])], ["lang", "window", "n"])
        languages.clear()
        keys.clear()
        counts.clear()

    for b in batches:
        own = [languages.setdefault(name, len(languages)) for name in b.column("lang").to_pylist()]
        row_lang = np.array(own, np.uint64) << np.uint64(48)
        for rows, first, window in segments(b.column("text")):
            n = np.diff(np.append(first, len(window)))
            u, count = np.unique(np.repeat(row_lang[rows], n) | window, return_counts=True)
            keys.append(u)
            counts.append(count)
            if sum(map(len, keys)) > 4 * GATHERED:
                keys[:], counts[:] = ([x] for x in _added(keys, counts))
        if len(languages) > 50_000 or sum(map(len, keys)) > 2 * GATHERED:
            yield from flushed()
    if keys:
        yield from flushed()


def context_counts(docs: DataFrame) -> DataFrame:
    """(lang, depth, window, n): how often each string of 1 to ORDER + 1 bytes ends at a byte of ``docs`` (text, lang)."""
    windows = docs.select("text", "lang").mapInArrow(count_windows, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    depths = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("depth"), F.col("window").bitwiseAND(int(_low(k + 1))).alias("window")) for k in range(ORDER + 1))))
    return windows.select("lang", "n", depths.alias("s")).groupBy("lang", "s.depth", "s.window").agg(F.sum("n").alias("n"))


class Tree:
    """One language's nodes by depth, with what code lengths need about each context."""

    def __init__(self, depth: np.ndarray, window: np.ndarray, n: np.ndarray) -> None:
        self.levels = []
        above = None
        for k in range(ORDER + 1):
            own = depth == k + 1
            key = window[own].astype(np.uint64)
            order = np.argsort(key)
            key, count = key[order], n[own][order].astype(np.float64)
            context = key >> np.uint64(8)
            heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, int)
            total = np.add.reduceat(count, heads) if len(heads) else count[:0]
            distinct = np.diff(np.append(heads, len(key))).astype(np.float64)
            shorter = np.zeros(0)
            if k and len(heads):  # how often the next shorter context was followed by the bytes that follow this one
                key_above, count_above = above
                shorter = np.add.reduceat(count_above[np.searchsorted(key_above, key & _low(k))], heads)
            self.levels.append((key, count, context[heads], total, distinct, shorter))
            above = key, count

    def code_lengths(self, window: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each window costs after the bytes before it."""
        bits, done = np.zeros(len(window)), np.zeros(len(window), bool)
        seen, used = np.zeros(len(window)), np.zeros(len(window))  # counts and bytes that a longer context excludes
        for k in range(ORDER, -1, -1):
            key, count, contexts, total, distinct, shorter = self.levels[k]
            if not len(key):
                continue
            context, node = (window >> np.uint64(8)) & _low(k), window & _low(k + 1)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            here = np.minimum(np.searchsorted(key, node), len(key) - 1)
            found = known & (key[here] == node)
            left, kinds = total[at] - seen, distinct[at] - used
            whole = left + np.where(distinct[at] < _SYMBOLS, kinds, 0)
            hit = found & ~done
            bits[hit] += np.log2(whole[hit]) - np.log2(count[here[hit]])
            done |= hit
            escape = known & ~done & (kinds > 0)
            bits[escape] += np.log2(whole[escape]) - np.log2(kinds[escape])
            seen = np.where(known, shorter[at] if k else 0.0, 0.0)
            used = np.where(known, distinct[at], 0.0)
        bits[~done] += np.log2(np.maximum(_SYMBOLS - used[~done], 1))
        return bits


class Model:
    """The trees of all languages, in order of code point."""

    def __init__(self, languages: list[str], trees: list[Tree]) -> None:
        self.languages, self.trees = languages, trees
        self.key = self.bits = None
        self.stored = 0

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "trees": self.trees, "key": None, "bits": None, "stored": 0}

    def exact(self, window: np.ndarray) -> np.ndarray:
        return np.column_stack([t.code_lengths(window) for t in self.trees])

    def _places(self, window: np.ndarray) -> np.ndarray:
        """Where each window is in the memo, or the empty place where its search ended."""
        place = ((window * _MULTIPLIER) >> self.shift).astype(np.int64)
        there = self.key.take(place)
        left = np.flatnonzero((there != window) & (there != _ABSENT))
        while len(left):
            at = (place[left] + 1) & (len(self.key) - 1)
            place[left] = at
            there = self.key.take(at)
            left = left[(there != window[left]) & (there != _ABSENT)]
        return place

    def code_lengths(self, window: np.ndarray) -> np.ndarray:
        """One column of bits a language; a window that isn't in the memo is worked out and stored there."""
        if self.key is None or self.stored > len(self.key) // 2:
            size = max(1 << 20, MEMO >> max(0, (len(self.trees) - 1).bit_length() - 2))
            self.key, self.bits, self.stored = np.full(size, _ABSENT), np.zeros((size, len(self.trees))), 0
            self.shift = np.uint64(64 - (size.bit_length() - 1))
        place = self._places(window)
        while True:
            missed = np.flatnonzero(self.key.take(place) != window)
            if not len(missed):
                return self.bits.take(place, axis=0)
            fresh = np.unique(window[missed])
            self._store(fresh, self.exact(fresh))
            place[missed] = self._places(window[missed])

    def _store(self, window: np.ndarray, costs: np.ndarray) -> None:
        while len(window):
            place = self._places(window)
            self.key[place] = window
            won = self.key.take(place) == window  # of those that met in one place, one is there now
            self.bits[place[won]] = costs[won]
            self.stored += int(won.sum())
            window, costs = window[~won], costs[~won]

    def totals(self, column: pa.Array) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(column), len(self.trees)))
        for rows, first, window in segments(column):
            out[rows] += np.add.reduceat(self.code_lengths(window), first, axis=0)
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each text's language among ``languages``, and its share of the probability of all."""
        bits = self.totals(column)
        best = bits.argmin(axis=1)
        ahead = bits - bits[np.arange(len(bits)), best][:, None]
        return best, 1.0 / np.exp2(-ahead).sum(axis=1)


def fit(docs: DataFrame, nodes: int = MODEL_NODES) -> Model:
    """The trees of all texts of ``docs`` (text, lang) whose text and lang aren't null."""
    counts = context_counts(docs.filter("text is not null and text <> '' and lang is not null"))
    # Pruning needs how many nodes of a language have about so many uses: at most 504 rows a language.
    counts = counts.persist()
    try:
        step = F.floor(F.log2("n") * 8).cast("int")
        sizes: dict[str, dict[int, int]] = {}
        for r in counts.groupBy("lang", step.alias("step")).count().collect():
            sizes.setdefault(r["lang"], {})[r["step"]] = r["count"]
        share, least = nodes // max(1, len(sizes)), []
        for name, steps in sizes.items():
            kept, cut = 0, max(steps) + 1
            for k in sorted(steps, reverse=True):
                kept += steps[k]
                if kept > share:
                    break
                cut = k
            least.append((name, cut))
        if not least:
            return Model([], [])
        cuts = docs.sparkSession.createDataFrame(least, "lang string, least int")  # one row a language
        found = counts.withColumn("step", step).join(F.broadcast(cuts), "lang").filter("step >= least").select("lang", "depth", "window", "n").toArrow()
    finally:
        counts.unpersist()
    names = found.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(sizes)  # by code point
    depth, window, n = (found.column(c).to_numpy() for c in ("depth", "window", "n"))
    place = np.searchsorted(np.array(languages, object), names)
    return Model(languages, [Tree(depth[place == i], window[place == i], n[place == i]) for i in range(len(languages))])


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for b in batches:
            best, score = model.predict(b.column("text")) if len(b) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lettered"), names.take(pa.array(best)), pa.array(score)], ["doc_id", "lettered", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learnable: Column, nodes: int = MODEL_NODES) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, learned from the rows of ``docs`` that are ``learnable``."""
    model = fit(docs.filter(learnable).select("text", "lang"), nodes)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if not model.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``nodes`` nodes
    found = rows.mapInArrow(_predictions(shared), "doc_id long, lettered boolean, lang_pred string, score double")
    return found.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    found = identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
