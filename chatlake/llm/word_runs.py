"""Periodic runs of words, found on a grammar of each document.

A run is a longest stretch of words with period q (words q apart are equal, q the smallest such
number) that is at least ``least`` words and ``times`` (three or more) periods long. Each document's words are
compressed by Re-Pair: the pair of symbols that occurs most often gives way to a new symbol,
until no pair occurs twice. Pairs that don't compete for a symbol are replaced in one round, over
all documents of a chunk. What is left of a document is joined by a balanced tree, whose nodes
occur once.

A run lies in some symbol's expansion, across the boundary of its two halves. So the boundary of
each symbol is looked at once, at the place where the symbol was made: periods whose words agree at
the boundary are extended to both sides, no further than the expansion, by comparing hashes of doubling
length. What was found is then carried to every place that the symbol derives. A run cut short by an
expansion's end lies in a longer one of a symbol above it, so of one period's runs those inside
another go; of equal stretches the smallest period stays. Every run is checked word by word,
and a chunk where a hash misled is done again with other hashes.

A task holds a chunk of whole documents; nothing is shuffled.

Defined cases: a null, empty or blank text has no words and no run; repeated rows are treated alike; a null
doc_id is a document like any other; an empty table gives an empty result; ``without_runs`` keeps all
other columns, whatever their names, and a null text. A very long text is one chunk, whose memory grows with its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T

LEAST, TIMES = 24, 3
#: Pairs of a boundary and a period that are looked at together.
BLOCK = 1 << 20


def numbered(w: T.Words) -> np.ndarray:
    """A number for each word; equal numbers are equal words, by both lanes."""
    _, at, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    if not np.array_equal(w.second[at][number], w.second):
        number = np.unique(np.column_stack([w.hashes, w.second]), axis=0, return_inverse=True)[1].reshape(-1)
    return number


@dataclass
class Grammar:
    """Symbols under ``words`` are words; rule k makes symbol words + k of two smaller ones.

    ``place`` is the word where a rule's first occurrence begins, ``rounds`` says which rules were made
    together, and ``symbol`` and ``start`` are what is left of the documents, in order.
    """

    words: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    place: np.ndarray
    rounds: list[tuple[int, int]]
    symbol: np.ndarray
    start: np.ndarray

    def sizes(self, symbol: np.ndarray) -> np.ndarray:
        """How many words symbols stand for."""
        return np.where(symbol < self.words, 1, self.length[np.maximum(symbol - self.words, 0)] if len(self.length) else 1)


def _chosen(priority: np.ndarray) -> np.ndarray:
    """Pairs, by the place of their first symbol, that outrank both pairs sharing a symbol with them; of a stretch of equal pairs every second one."""
    n = len(priority)
    head = np.append(True, priority[1:] != priority[:-1])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], n) - 1
    around = np.concatenate([[0], priority, [0]])
    wins = (priority[heads] > around[heads]) & (priority[heads] > around[tails + 2])
    offset = np.arange(n) - np.repeat(heads, tails - heads + 1)
    return np.flatnonzero(np.repeat(wins, tails - heads + 1) & (offset % 2 == 0))


def re_pair(word: np.ndarray, row: np.ndarray) -> Grammar:
    """The grammar of the rows' words; a pair counts within its row, and so do its rules."""
    words = int(word.max()) + 1 if len(word) else 0
    base = words + len(word) + 1  # each rule takes at least one symbol away, so no more are made
    symbol, start = word.astype(np.int64), np.arange(len(word))
    row = row.astype(np.int64)
    left, right, length, place = (np.zeros(0, np.int64) for _ in range(4))
    known, known_id, rounds, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
    while len(symbol) > 1:
        at = np.flatnonzero(row[1:] == row[:-1])
        pair, which, n = np.unique((row[at] * base + symbol[at]) * base + symbol[at + 1], return_inverse=True, return_counts=True)
        again = n[which] > 1
        busy = np.zeros(int(row[-1]) + 1, bool)
        busy[row[at[again]]] = True
        live = busy[row]
        if not live.all():  # rows without a pair that repeats are done
            rest.append((symbol[~live], start[~live]))
        if not live.any():
            symbol, start = symbol[:0], start[:0]
            break
        rank = np.empty(len(pair), np.int64)
        rank[np.lexsort((T.mix(pair.astype(np.uint64)), n))] = np.arange(1, len(pair) + 1)
        priority = np.zeros(len(symbol), np.int64)
        priority[at[again]] = rank[which[again]]
        place_of = np.full(len(symbol), -1)
        place_of[at] = which
        first = _chosen(priority)
        first = first[priority[first] > 0]
        made, begin, mine = np.unique(place_of[first], return_index=True, return_inverse=True)
        key, lead = pair[made], first[begin]
        ids = np.full(len(key), -1, np.int64)
        if len(known):
            found = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ids = np.where(known[found] == key, known_id[found], -1)
        fresh = ids < 0
        ids[fresh] = words + len(left) + np.arange(fresh.sum())
        rounds.append((len(left), len(left) + int(fresh.sum())))
        a, b = symbol[lead[fresh]], symbol[lead[fresh] + 1]
        sizes = np.concatenate([np.ones(words, np.int64), length])
        left, right = np.concatenate([left, a]), np.concatenate([right, b])
        length, place = np.concatenate([length, sizes[a] + sizes[b]]), np.concatenate([place, start[lead[fresh]]])
        known, known_id = np.concatenate([known, key[fresh]]), np.concatenate([known_id, ids[fresh]])
        order = np.argsort(known)
        known, known_id = known[order], known_id[order]
        symbol = symbol.copy()
        symbol[first] = ids[mine]
        live[first + 1] = False
        symbol, start, row = symbol[live], start[live], row[live]
    rest.append((symbol, start))
    symbol, start = np.concatenate([s for s, _ in rest]), np.concatenate([s for _, s in rest])
    order = np.argsort(start)
    return Grammar(words, left, right, length, place, rounds, symbol[order], start[order])


def _tree(start: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """(begin, boundary, end) of the nodes of at least ``least`` words in balanced trees over each row's symbols."""
    row = np.searchsorted(first, start, "right") - 1
    end = np.append(start[1:], first[-1])
    out = [np.zeros((0, 3), np.int64)]
    while len(start):
        heads = np.searchsorted(row, row)
        odd = (np.arange(len(start)) - heads) % 2 == 1
        second = np.flatnonzero(odd)
        if not len(second):
            break
        nodes = np.column_stack([start[second - 1], start[second], end[second]])
        out.append(nodes[nodes[:, 2] - nodes[:, 0] >= least])
        end[second - 1] = end[second]
        start, end, row = start[~odd], end[~odd], row[~odd]
    return np.concatenate(out)


class _Extensions:
    """How far words stay equal to those ``q`` later, by hashes of blocks."""

    def __init__(self, word: np.ndarray, seed: int) -> None:
        self.seed = seed
        value = T.mix(word.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        self.base = np.uint64(int(T.mix(np.array([seed + 1], np.uint64))[0]) | 1)
        self.power = np.full(len(word) + 1, self.base)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(value * self.power[:-1], out=self.sums[1:])

    def _equal(self, at: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        s = self.sums
        return (s[at + n] - s[at]) * self.power[q] == s[at + q + n] - s[at + q]

    def ahead(self, at: np.ndarray, q: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on, ``end`` at most, whose word differs from that ``q`` later."""
        at, size = at.copy(), 1 << int(max(0, (end - at).max(initial=0))).bit_length()
        while size:
            can = np.flatnonzero(at + size <= end)
            at[can[self._equal(at[can], q[can], size)]] += size
            size >>= 1
        return at

    def behind(self, at: np.ndarray, q: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The first place of the stretch of such words that ends before ``at``, ``begin`` at least."""
        at, size = at.copy(), 1 << int(max(0, (at - begin).max(initial=0))).bit_length()
        while size:
            can = np.flatnonzero(at - size >= begin)
            at[can[self._equal(at[can] - size, q[can], size)]] -= size
            size >>= 1
        return at


def _across(word: np.ndarray, nodes: np.ndarray, ext: _Extensions, least: int, times: int) -> np.ndarray:
    """(node, begin, end, period) of the runs that cross nodes' boundaries, cut at the nodes' ends."""
    top = np.concatenate([[0], np.cumsum((nodes[:, 2] - nodes[:, 0]) // times)])
    out = [np.zeros((0, 4), np.int64)]
    last = len(word) - 1
    for a in range(0, int(top[-1]), BLOCK):
        flat = np.arange(a, min(a + BLOCK, top[-1]))
        node = np.searchsorted(top, flat, "right") - 1
        q = flat - top[node] + 1
        begin, mid, end = nodes[node].T
        # The last word before the boundary repeats q later, and so does one beside it.
        at = mid - 1
        hit = np.flatnonzero((word[at] == word[np.minimum(at + q, last)]) & (at + q < end))
        i, n = at[hit], q[hit]
        hit = hit[((mid[hit] + n < end[hit]) & (word[i + 1] == word[np.minimum(i + 1 + n, last)])) | ((i > begin[hit]) & (word[i - 1] == word[i - 1 + n]))]
        # Or both words at the boundary repeat those q earlier.
        other = np.flatnonzero((at - q >= begin) & (word[at] == word[np.maximum(at - q, 0)]))
        other = other[word[mid[other]] == word[mid[other] - q[other]]]
        near = np.concatenate([hit, other])
        anchor = np.concatenate([at[hit], mid[other] - q[other]])
        n = q[near]
        lo = ext.behind(anchor, n, begin[near])
        hi = ext.ahead(anchor, n, end[near] - n) + n
        long = (hi - lo >= np.maximum(least, times * n)) & (hi > anchor + n)
        out.append(np.column_stack([node[near], lo, hi, n])[long])
    found = np.concatenate(out)
    # Of equal stretches of one node, the smallest period.
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[: len(found)]]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + n: which range, and the member, end to end."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(first, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _derived(g: Grammar, rule: np.ndarray, run: np.ndarray) -> np.ndarray:
    """(begin, end, period) at every place that rules with runs derive; ``run`` is relative to its rule's begin, in order of ``rule``."""
    own = np.searchsorted(rule, np.arange(len(g.left) + 1))
    has = np.diff(own) > 0
    inner = g.left - g.words, g.right - g.words
    for a, b in g.rounds:
        for side in inner:
            child = side[a:b]
            has[a:b] |= (child >= 0) & has[np.maximum(child, 0)]
    top = g.symbol >= g.words
    at, symbol, out = g.start[top], g.symbol[top] - g.words, [np.zeros((0, 3), np.int64)]
    at, symbol = at[has[symbol]], symbol[has[symbol]]
    while len(symbol):
        which, k = _spread(own[symbol], own[symbol + 1] - own[symbol])
        out.append(run[k] + np.column_stack([at[which], at[which], np.zeros_like(which)]))
        two = np.concatenate([inner[0][symbol], inner[1][symbol]])
        at = np.concatenate([at, at + g.sizes(g.left[symbol])])
        keep = (two >= 0) & has[np.maximum(two, 0)]
        at, symbol = at[keep], two[keep]
    return np.concatenate(out)


def _wrong(word: np.ndarray, runs: np.ndarray) -> bool:
    """Whether a word of some run differs from that one period later."""
    n = runs[:, 1] - runs[:, 2] - runs[:, 0]
    done = 0
    while done < len(runs):  # whole runs, as many as fit in a block, or one longer one
        upto = max(done + 1, int(np.searchsorted(np.cumsum(n[done:]), BLOCK, "right")) + done)
        which, at = _spread(runs[done:upto, 0], n[done:upto])
        if (word[at] != word[at + runs[done:upto, 2][which]]).any():
            return True
        done = upto
    return False


def runs_of(word: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(row, start, length, period) of every run, by row, start and period; rows are word[first[i]:first[i + 1]]."""
    if times < 3:
        raise ValueError("the test at a boundary finds runs of three periods and more")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = re_pair(word, row)
    long = np.flatnonzero(g.length >= least)
    halves = g.place[long] + g.sizes(g.left[long])
    nodes = np.concatenate([np.column_stack([g.place[long], halves, g.place[long] + g.length[long]]), _tree(g.start, first, least)])
    seed = 1
    while True:
        found = _across(word, nodes, _Extensions(word, seed), least, times)
        of_rule = found[:, 0] < len(long)
        rule = long[found[of_rule, 0]]
        shift = g.place[rule]
        everywhere = np.concatenate([_derived(g, rule, found[of_rule, 1:] - np.column_stack([shift, shift, np.zeros_like(shift)])), found[~of_rule, 1:]])
        begin, end, period = everywhere.T
        home = row[begin] if len(begin) else begin
        order = np.lexsort((-end, begin, period, home))
        home, begin, end, period = (x[order] for x in (home, begin, end, period))
        group = np.cumsum(np.append(True, (home[1:] != home[:-1]) | (period[1:] != period[:-1]))[: len(home)])
        reach = np.maximum.accumulate(end + group * (len(word) + 1)) if len(end) else end
        new = np.append(True, (end + group * (len(word) + 1))[1:] > reach[:-1])[: len(end)]
        runs = np.column_stack([begin, end, period])[new]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]]
        if not _wrong(word, runs):
            break
        seed += 1
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    home = row[runs[:, 0]] if len(runs) else runs[:, 0]
    return np.column_stack([home, runs[:, 0] - first[home], runs[:, 1] - runs[:, 0], runs[:, 2]])


def in_chunks(column: pa.Array, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[T.Words, np.ndarray, np.ndarray]]:
    """(words, runs, which words stay) chunk by chunk; a word goes if some run has it after its first period."""
    for w in T.words(column):
        runs = runs_of(numbered(w), w.first, least, times) if len(w.hashes) else np.zeros((0, 4), np.int64)
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        begin = w.first[runs[:, 0]] + runs[:, 1]
        np.add.at(edge, begin + runs[:, 3], 1)
        np.add.at(edge, begin + runs[:, 2], -1)
        yield w, runs, np.cumsum(edge)[:-1] == 0


def _lists(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w, runs, _ in in_chunks(b.column("text"), least, times):
            parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
            first = pa.array(np.searchsorted(runs[:, 0], np.arange(w.rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.row0, w.rows), pa.ListArray.from_arrays(first, parts)], ["doc_id", "runs"])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs) of every document: an array of (start, length, period), by start and period."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _lists(batches, least, times), "doc_id long, runs array<struct<start: long, length: long, period: long>>")


def without_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with one period left of every run; texts that have a run become their kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, at = b.schema.names, b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            for w, runs, keep in in_chunks(b.column(at), least, times):
                if keep.all():
                    continue
                body, _, bounds = T.joined(w, keep)
                for i in np.unique(runs[:, 0]).tolist():
                    texts[w.row0 + i] = body[bounds[i] : bounds[i + 1]].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest columns of (doc_id, text)."""
    for b in batches:
        for w, runs, keep in in_chunks(b.column("text")):
            body, _, bounds = T.joined(w, keep)
            view = memoryview(body)
            collapsed = [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            best: list[tuple | None] = [None] * w.rows
            lines: list[list[str]] = [[] for _ in range(w.rows)]
            for row, start, length, period in runs.tolist():
                if best[row] is None or length * best[row][2] > best[row][1] * period:  # exact; the earlier of equal ones stays
                    best[row] = start, length, period
                lines[row].append(f"{start},{length},{period}\n")
            top = [[x and x[k] for x in best] for k in range(3)]
            milli = [x and 1000 * x[1] // x[2] for x in best]
            listed = [hashlib.sha256("".join(x).encode()).hexdigest() for x in lines]
            columns = [pa.array(list(map(len, lines)), pa.int64()), *(pa.array(x, pa.int64()) for x in (*top, milli)), pa.array(listed), pa.array(collapsed)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.row0, w.rows), *columns], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_tail(doc_id: int | None, text: str | None) -> str | None:
    """The query's own documents: in one of ten, by its id, the words from some place on repeat those at that place."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return text
    words = (text or "").encode().split()
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]).decode()


def _with_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [periodic_tail(d, t) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: digests(_with_tails(batches)), DIGESTS)
