"""Substring dedup with suffix automata of reference shards.

A reference shard is all texts that share one minimiser key, in order of their
owners: what any window with that key can repeat. Its suffix automaton grows text by
text; each next text is streamed through it for matching statistics, and positions
whose match reaches the window length in a smaller document are marked. Marked windows
of a document, joined to maximal spans, are removed.

A shard's automaton is built in the task where its texts meet, which is also where all
the texts to be streamed through it are. Sending every shard to every document, as
a plain broadcast would, is the same work times the number of shards.

Defined cases: a null text has no words; a null doc_id is compared with nothing and
keeps its text; rows sharing a doc_id don't repeat each other; a text shorter than
the window is kept; an empty table gives an empty result; other columns are carried
by ``remove_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.passages import WINDOW, cover, repeated_spans, text_key
from chatlake.llm.scratch import free_names


class SuffixAutomaton:
    """All substrings of the texts added so far, each state with the first owner of its substrings.

    Texts must be added in ascending order of owner, so that first means smallest.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.owner = [-1], [0], [-1]

    def _state(self, length: int, edges: dict[int, int], link: int, owner: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.owner.append(owner)
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The part of q that is reached from p, as a state of its own."""
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], self.owner[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:  # known from an earlier text
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                continue
            cur = self._state(length[last] + 1, {}, 0, owner)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = cur

    def owners_of_windows(self, words: list[int], window: int) -> list[int]:
        """For each window of ``words``, the smallest owner that has it, or -1.

        The matching statistic, the longest suffix read so far that is a known substring, is
        cut to the window, so that its state always tells of exactly that window.
        """
        nxt, link, length, owner = self.next, self.link, self.len, self.owner
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
                while length[link[state]] >= window:
                    state = link[state]
                if matched > window:
                    matched = window
            if i >= window - 1:
                out.append(owner[state] if matched >= window else -1)
        return out


def automaton_engine(window: int = WINDOW):
    """The comparison of ``repeated_spans`` by suffix automata, a shard for each key."""

    def engine(lengths, owners, keys, words, hashes):
        ends = np.cumsum(lengths)
        hit, start, count, other = [], [], [], []
        shard = None
        for i in range(len(lengths)):
            own = words[ends[i] - lengths[i] : ends[i]].tolist()
            owner = int(owners[i])
            if shard is None or keys[i] != keys[i - 1]:
                shard = SuffixAutomaton()
            else:
                found = shard.owners_of_windows(own, window)
                at = 0
                while at < len(found):
                    o = found[at]
                    stop = at + 1
                    while stop < len(found) and found[stop] == o:
                        stop += 1
                    if 0 <= o < owner:
                        hit.append(i)
                        start.append(at)
                        count.append(stop - at)
                        other.append(o)
                    at = stop
            if i + 1 < len(lengths) and keys[i + 1] == keys[i]:
                shard.add(own, owner)
        return np.array(hit, np.int64), np.array(start, np.int64), np.array(count, np.int64), np.array(other, np.int64)

    return engine


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, windows, other): what substring dedup removes."""
    return repeated_spans(docs, automaton_engine(window), window)


def _with_spans(docs: DataFrame, window: int, name: str = "_spans") -> DataFrame:
    """``docs`` with their spans of removed words, as (start, length) in ``name``."""
    doc, key = free_names([*docs.columns, name], "_doc_id", "_text_key")
    length = F.col("windows") + F.lit(window - 1)
    spans = removed_spans(docs.select("doc_id", "text"), window).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", length.alias("length"))).alias(name))
    spans = spans.withColumnsRenamed({"doc_id": doc, "text_key": key})
    own = (F.col("doc_id") == F.col(doc)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(spans, own, "left").drop(doc, key)


def _kept(column: pa.Array, spans: pa.Array) -> Iterator[tuple[int, T.Words, np.ndarray]]:
    """(first row, words, which of them stay) chunk by chunk."""
    for w in T.words(column):
        own = spans.slice(w.row0, w.rows)
        flat = own.flatten()
        counts = np.asarray(own.value_lengths().fill_null(0))
        row = np.repeat(np.arange(w.rows), counts)
        start, length = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("length")).astype(np.int64)
        yield w.row0, w, ~cover(np.diff(w.first), row, start, length)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, sha = [], [], []
        for _, w, keep in _kept(b.column("text"), b.column("_spans")):
            n = np.diff(w.first)
            body, _, off = T.joined(w, keep)
            view = memoryview(body)
            total.append(n)
            removed.append(n - np.bincount(w.row_of()[keep], minlength=w.rows))
            sha += [hashlib.sha256(view[off[i] : off[i + 1]]).hexdigest() for i in range(w.rows)]
        if sha:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.concatenate(total)), pa.array(np.concatenate(removed)), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    rows = _with_spans(docs.select("doc_id", "text"), window).select("doc_id", "text", "_spans")
    return rows.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``.

    A document that loses words becomes its kept words joined by one space; one left
    without words is dropped; one that loses nothing keeps its text as it is.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    (name,) = free_names(docs.columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for row0, w, keep in _kept(b.column("text"), b.column(name)):
                body, _, off = T.joined(w, keep)
                lost = np.diff(w.first) - np.bincount(w.row_of()[keep], minlength=w.rows)
                for i in range(w.rows):
                    texts.append(b.column("text")[row0 + i].as_py() if not lost[i] else body[off[i] : off[i + 1]].tobytes().decode() or None)
            gone = pa.array([t is None and b.column("text")[i].is_valid for i, t in enumerate(texts)], pa.bool_())
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(schema.names))]
            t = pa.RecordBatch.from_arrays(columns, schema.names)
            yield t.filter(pa.compute.invert(gone))

    return _with_spans(docs, window, name).select(*docs.columns, name).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Words and windows as SQL sees them: (doc_id, pos, word), and which words a repeated window covers.
COVERED = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL
), word AS (
  SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM w
), win AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 49), ' ') AS body FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w)
), first AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY body) AS other FROM win
), covered AS (
  SELECT word.doc_id, word.pos, word.word, other, count(other) OVER (PARTITION BY word.doc_id ORDER BY word.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM word LEFT JOIN (SELECT * FROM first WHERE other < doc_id) AS f ON f.doc_id = word.doc_id AND f.pos = word.pos
)"""

SQL = COVERED + """
SELECT d.doc_id, count(c.pos) AS n_words, count_if(coalesce(c.gone, false))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
