"""Ranked lexical search by NRA: impact-sorted lists read in order, no look-up of a document.

A term's impact in a document is a whole number (``impacts``), a document's score for an item the sum of the
impacts of the item's terms. Work is dealt by documents: a task takes its documents a shard
at a time, makes the shard's posting lists of the items' terms, highest impact first, and for each item
reads its lists from the top, the same depth in all. What a document has been seen with is its
lower bound; the upper bound adds, for each list where it wasn't seen yet, the impact reached there. Reading ends
when no document that was not seen could still be among the best ``k``, and every document
that could has equal bounds: membership, ties and scores are then settled. A task takes its best
``k`` of an item from shard to shard, so later shards need beat them; Spark ranks the tasks' lists.

Jobs for one block of items: (1) the block's terms, at most BLOCK_TERMS in all unless one item has more, go to the
tasks; (2) one pass over the texts stores each document's number of terms and its postings of those terms; (3) document
frequencies are added up from that table; (4) the shards are searched. More items are more blocks, never more
memory. A term is 128 bits of its bytes (see ``text``).

Defined cases: a null, empty or blank text has no term and is never found; rows with a null doc_id count
as documents in the statistics and are never found; rows that repeat a doc_id are documents each; an item's rows
with one item_id are one item, and its repeated terms count once; a null item_id is no item; an item without
terms, or whose terms nobody has, has no rows; equal scores go by doc_id; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.scratch import stored

TOP = 10
BLOCK_TERMS = 1 << 20
#: Documents of a shard, and how many postings of each list are read at first; every further reading doubles.
SHARD, DEPTH = 1 << 14, 64

#: Everything of ASCII but digits and letters.
_SEPARATOR = ~T.lookup([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in T.words(b.column("text"), lower=True, separators=_SEPARATOR):
            lanes = [pa.array(x.view(np.int64)) for x in (w.hashes, w.second)]
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(w.row0 + w.row_of())), *lanes], ["item_id", "one", "two"])


@dataclass
class Terms:
    """The distinct terms of a block of items in order of their lanes, and the terms of each item."""

    one: np.ndarray
    two: np.ndarray
    items: np.ndarray
    first: np.ndarray
    of_item: np.ndarray
    seldom: np.ndarray = field(default=None)

    @classmethod
    def of(cls, item: np.ndarray, one: np.ndarray, two: np.ndarray) -> Terms:
        order = np.lexsort((two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(order)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        by = np.lexsort((number, item))
        items, first = np.unique(item[by], return_index=True)
        out = cls(one[order][new], two[order][new], items, np.append(first, len(by)), number[by])
        out.seldom = np.zeros(1 << 20, bool)
        out.seldom[out.one & np.uint64((1 << 20) - 1)] = True
        return out

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, their numbers)."""
        at = np.flatnonzero(self.seldom[one & np.uint64((1 << 20) - 1)])
        number = np.searchsorted(self.one, one[at])
        ok = number < len(self.one)
        at, number = at[ok], number[ok]
        while len(at):
            same = self.one[number] == one[at]
            right = same & (self.two[number] == two[at])
            # Terms that share lane one lie side by side; go on while there is one more of them.
            more = same & ~right & (number + 1 < len(self.one))
            if not more.any():
                return at[right], number[right]
            number = np.where(more, number + 1, number)
            keep = right | more
            at, number = at[keep], number[keep]
        return at, number


def _postings(shared):
    """(doc_id, n, terms, times) of every document with a term: those of the block's terms, by number, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for b in batches:
            for w in T.words(b.column("text"), lower=True, separators=_SEPARATOR):
                at, number = terms.find(w.hashes, w.second)
                row = np.searchsorted(w.first, at, "right") - 1
                key, tf = np.unique(row << 32 | number, return_counts=True)
                first = np.searchsorted(key, np.arange(w.rows + 1) << 32).astype(np.int32)
                n = np.diff(w.first)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((key & 0xFFFFFFFF).astype(np.int32), tf)]
                rows = pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.row0, w.rows), pa.array(n), *lists], ["doc_id", "n", "terms", "times"])
                yield rows.filter(pa.array(n > 0))

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): how many documents have a term; -1 stands for documents, -2 for all their terms."""
    found, docs, length = np.zeros(0, np.int64), 0, 0
    for b in batches:
        own = np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(found))
        own[: len(found)] += found
        found, docs, length = own, docs + len(b), length + int(b.column("n").to_numpy().sum())
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(found[some], [docs, length]))], ["term", "n"])


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    m = 10 + (90 * n * docs) // length
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of some documents: of each term (document's place, impact), highest impact first."""

    def __init__(self, size: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> None:
        some = impact > 0
        term, doc, impact = term[some], doc[some], impact[some]
        order = np.lexsort((-impact, term))
        self.size, self.doc, self.impact = size, doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))

    def best(self, terms: np.ndarray, k: int, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that can be among the best ``k`` beside those scored ``carried``, higher first."""
        at, end = self.first[terms], self.first[terms + 1]
        at, end = at[end > at], end[end > at]
        lists = len(at)
        reached = self.impact[at]
        if not lists or (len(carried) >= k and reached.sum() < carried[k - 1]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, seen = np.zeros(self.size, np.int64), np.zeros((self.size, lists), bool)
        ruled_out = np.zeros(self.size, bool)
        depth = DEPTH
        while True:
            n = np.minimum(end - at, depth)
            which = np.repeat(np.arange(lists), n)
            read = np.repeat(at - np.cumsum(n) + n, n) + np.arange(len(which))
            doc = self.doc[read]
            np.add.at(lower, doc, self.impact[read])
            seen[doc, which] = True
            at = at + n
            reached = np.where(at < end, self.impact[np.maximum(at - 1, 0)], 0)
            depth *= 2
            candidates = np.flatnonzero((lower > 0) & ~ruled_out)
            low = lower[candidates]
            high = np.sort(np.concatenate([carried, low]))[::-1]
            least = max(1, int(high[k - 1])) if len(high) >= k else 1
            upper = low + (~seen[candidates] * reached).sum(axis=1)
            open_ = upper >= least
            ruled_out[candidates[~open_]] = True
            if reached.sum() < least and (upper[open_] == low[open_]).all():
                found = candidates[low >= least]
                return found, lower[found]


def _searched(shared, weights, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w = shared.value, weights.value
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(ids: np.ndarray, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(ids)), size)
            shard = Shard(len(ids), term, doc, impacts(w[term], tf, n[doc], docs, length), len(w))
            for i in range(len(terms.items)):
                scores, found = top.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                place, score = shard.best(terms.of_item[terms.first[i] : terms.first[i + 1]], k, scores)
                if len(place):
                    score, found = np.concatenate([scores, score]), np.concatenate([found, ids[place]])
                    order = np.lexsort((found, -score))[:k]
                    top[i] = score[order], found[order]

        held: list[tuple] = []
        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            for a in range(0, len(b), SHARD):
                part = b.slice(a, SHARD)
                lists = part.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                held.append((part.column("doc_id").to_numpy(), part.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), part.column("times").flatten().to_numpy()))
                if sum(len(x[0]) for x in held) >= SHARD:
                    search(*map(np.concatenate, zip(*held, strict=True)))
                    held.clear()
        if held:
            search(*map(np.concatenate, zip(*held, strict=True)))
        for i, (score, found) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), terms.items[i])), pa.array(found), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    found = wanted.toArrow()  # a block's terms
    item, one, two = (found.column(c).to_numpy() for c in ("item_id", "one", "two"))
    terms = Terms.of(item, one.view(np.uint64), two.view(np.uint64))
    shared = spark.sparkContext.broadcast(terms)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = stored(rows.mapInArrow(_postings(shared), "doc_id long, n long, terms array<int>, times array<long>"), "postings")
    counts = {r["term"]: r["n"] for r in hits.select("n", "terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, length = counts.pop(-1, 0) or 0, counts.pop(-2, 0) or 0
    weights = np.zeros(len(terms.one), np.int64)
    for term, df in counts.items():
        weights[term] = weight(total, df)
    return hits.mapInArrow(_searched(shared, spark.sparkContext.broadcast(weights), total, length, k), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item."""
    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    wanted = stored(rows.mapInArrow(_item_terms, "item_id long, one long, two long").distinct(), "item-terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    found = None
    for i in range(blocks):
        part = _search_block(docs, wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
k AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM k),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM k) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM f, g),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // length AS m FROM k, g WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, p.r, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN m ON p.r = m.r GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
