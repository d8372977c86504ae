"""Suffix-array dedup with sparse suffix arrays.

Of all suffixes only those at minimiser positions are retained; every window of
WINDOW words holds one, at the same place in each copy. The retained suffixes of a key
range are sorted by the words to their right and, a second time, by the words to
their left. Comparing neighbours in the two orders gives the lengths of common extensions,
and two windows that start o words before their retained suffix are equal exactly
if no neighbour gap shorter than o to the left, or than WINDOW - o to the right, lies between
them. So equal windows are found by comparing neighbours and extending both ways,
without forming pairs.

Defined cases: as in ``passages``; null or short texts and null doc_ids have no
repeats, rows sharing a doc_id don't repeat each other, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.passages import GRAM, WINDOW, repeated_spans
from chatlake.llm.substring_dedup import COVERED


def _sorted_gaps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of some rows of words, and the words each shares with its predecessor there."""
    as_bytes = np.ascontiguousarray(rows.astype(">u4")).view(np.dtype((np.void, 4 * rows.shape[1]))).ravel()
    order = np.argsort(as_bytes, kind="stable")
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.append(-1, shared)


def suffix_engine(window: int = WINDOW, gram: int = GRAM):
    """The comparison of ``repeated_spans`` by sparse suffix arrays."""
    reach = window - gram

    def engine(lengths, owners, keys, words, hashes):
        ends = np.cumsum(lengths)
        begins = ends - lengths
        g = T.grams(hashes, gram)
        text = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(g))
        kept = np.flatnonzero((g == keys.view(np.uint64)[text[: len(g)]]) & (at + gram <= ends[text[: len(g)]]))
        own = text[kept]
        padded = np.concatenate([np.zeros(reach, np.int64), words + 1, np.zeros(window, np.int64)])
        right = padded[kept[:, None] + reach + np.arange(window)]
        left = padded[kept[:, None] + reach - 1 - np.arange(reach)]
        r_order, r_shared = _sorted_gaps(right)
        l_order, l_shared = _sorted_gaps(left)
        r_rank, l_rank = np.empty(len(kept), np.int64), np.empty(len(kept), np.int64)
        best = np.full(len(words) + 1, np.iinfo(np.int64).max)
        for o in range(reach + 1):
            r_rank[r_order] = np.cumsum(r_shared < window - o)
            l_rank[l_order] = np.cumsum(l_shared < o)
            start = kept - o
            ok = np.flatnonzero((start >= begins[own]) & (start + window <= ends[own]))
            both = r_rank[ok] * (len(kept) + 1) + l_rank[ok]
            order = np.argsort(both, kind="stable")
            same = both[order]
            head = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(same) else np.zeros(0, np.int64)
            if not len(head):
                continue
            who = owners[own[ok]][order]
            least = np.repeat(np.minimum.reduceat(who, head), np.diff(np.append(head, len(same))))
            where = least < who
            np.minimum.at(best, start[ok][order][where], least[where])
        hit = np.flatnonzero(best < np.iinfo(np.int64).max)
        if not len(hit):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        cut = np.append(True, (hit[1:] != hit[:-1] + 1) | (text[hit[1:]] != text[hit[:-1]]) | (best[hit[1:]] != best[hit[:-1]]))
        first = hit[cut]
        count = np.diff(np.append(np.flatnonzero(cut), len(hit)))
        return text[first], first - begins[text[first]], count, best[first]

    return engine


def _maximal(window: int):
    """Join a document's runs of repeated windows to maximal spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, start, length, other = [], [], [], []
            for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True):
                stop = -1
                for s in spans:  # in order of start
                    end = s["start"] + s["windows"] + window - 1
                    if s["start"] > stop:
                        ids.append(doc)
                        start.append(s["start"])
                        length.append(end - s["start"])
                        other.append(s["other"])
                    else:
                        length[-1] = max(length[-1], end - start[-1])
                        other[-1] = min(other[-1], s["other"])
                    stop = max(stop, end)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, start, length, other)], ["doc_id", "span_start", "span_words", "first_doc_id"])

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, span_start, span_words, first_doc_id): every maximal run of words that windows repeated from smaller documents cover.

    ``span_start`` counts words from 0; ``first_doc_id`` is the smallest document that has one of the span's windows.
    """
    spans = repeated_spans(docs.select("doc_id", "text"), suffix_engine(window), window, least_other=True)
    per = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "windows", "other"))).alias("spans"))
    return per.select("doc_id", "spans").mapInArrow(_maximal(window), "doc_id long, span_start long, span_words long, first_doc_id long")


def op8(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = COVERED + """, runs AS (
  SELECT doc_id, pos, other, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM covered WHERE gone
)
SELECT doc_id, min(pos) - 1 AS span_start, count(*) AS span_words, min(other) AS first_doc_id FROM runs GROUP BY doc_id, run
"""
