"""Passages that repeat across documents: what substring and suffix-array dedup share.

A window is WINDOW consecutive words. It is repeated if its word sequence also starts
in a document with a smaller doc_id. To find such windows without comparing every
document with every other, each window is keyed by its minimiser, the least hash of
its GRAM-word grams, which depends on the window's words alone: equal windows have
equal keys wherever they stand. Consecutive windows with one key form a piece, about
20 windows of text. Then

1. keys seen in one document only are dropped (an aggregation with partial sums);
2. pieces with equal text are one text (an aggregation), which stands for its first holder,
   the owner, and, where later documents hold it too, a second time for all of those;
3. the texts of a key, both times, are compared word by word, a key at a time, by
   the operator's own engine: suffix automata or sparse suffix arrays; what it finds
   for a text goes to the text's holders by a join;
4. a key with over ``max_texts`` texts (a frequent short phrase in many contexts) is
   split into its windows, which meet by the digest of all their words; there, later
   holders of a text repeat it as a whole.

Keys are hashes and only bring texts together. The engines get the words' bytes, numbered
within the task; equal texts, and windows of hot keys, are told by BLAKE2 digests of their bytes.

Step 4 is what bounds a group: nothing is dropped, and no list of a hot key's
holders is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.scratch import partitions, stored

WINDOW = 50
GRAM = 10
MAX_PIECE = 64
MAX_TEXTS = 1000

#: One engine call: (lengths, owners, keys, word numbers and word hashes of all texts of some whole keys) to (text, start, windows, smaller document).
Engine = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(text)


def pieces(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first word of the chunk, windows, key) of the pieces of some rows."""
    n = len(w.hashes)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if n < window:
        return none
    keys = T.sliding_min(T.grams(w.hashes, gram), window - gram + 1)
    row = w.row_of()
    inside = row[: len(keys)] == row[window - 1 :]
    change = np.ones(len(keys), bool)
    change[1:] = (keys[1:] != keys[:-1]) | ~inside[:-1] | (row[1 : len(keys)] != row[: len(keys) - 1])
    begin = np.flatnonzero(change)
    at = np.arange(len(keys))
    since = at - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    begin = np.flatnonzero((since % MAX_PIECE == 0) & inside)
    if not len(begin):
        return none
    stop = np.flatnonzero(np.append(((since[1:] % MAX_PIECE == 0) | ~inside[1:]) & inside[:-1], inside[-1])) + 1
    return row[begin], begin, stop - begin, keys[begin]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _piece_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tk = b.column("doc_id"), b.column("text_key")
            for w in T.words(b.column("text")):
                row, begin, windows, key = pieces(w, window, gram)
                if len(row):
                    at, content = pa.array(row + w.row0), T.joined_digests(w, begin, begin + windows + window - 1)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), tk.take(at), pa.array((begin - w.first[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), _signed(key), pa.array(content, pa.binary())],
                        ["doc_id", "text_key", "start", "windows", "key", "content"],
                    )

    return run


PIECE = "doc_id long, text_key long, start int, windows int, key long, content binary"


def candidate_pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The pieces whose key two documents have, stored."""
    named = docs.filter("doc_id is not null and text is not null").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    every = stored(named.mapInArrow(_piece_rows(window, gram), PIECE), "pieces")
    shared = every.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key")
    return stored(every.join(stored(shared, "keys"), "key"), "candidates")


CUT = "key long, content binary, owner long, last long, words binary, start int, hash binary"


def _cut(window: int):
    """Cut the wanted pieces out of the texts: a piece's words, or, where its key is hot, the digest of each window."""
    names = [c.split()[0] for c in CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wants, ids = b.column("wants"), b.column("doc_id")
            for w in T.words(b.column("text")):
                own = wants.slice(w.row0, w.rows)
                flat = own.flatten()
                row = np.repeat(np.arange(w.rows), np.asarray(own.value_lengths()))
                at = w.first[row] + np.asarray(flat.field("start"))
                windows = np.asarray(flat.field("windows")).astype(np.int64)
                hot = np.asarray(flat.field("hot"))
                body, place, _ = T.joined(w)
                size = w.ends - w.starts
                for some in (np.flatnonzero(~hot), np.flatnonzero(hot)):
                    if not len(some):
                        continue
                    first, n = at[some], windows[some]
                    if hot[some[0]]:
                        rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        begin = np.repeat(first, n) + rel
                        some = np.repeat(some, n)
                        hashes = T.joined_digests(w, begin, begin + window, (body, place))
                        cells = [pa.nulls(len(some), pa.binary()), pa.array(rel.astype(np.int32)), pa.array(hashes, pa.binary())]
                    else:
                        last = first + n + window - 2
                        view = memoryview(body)
                        texts = [view[a:b] for a, b in zip(place[first].tolist(), (place[last] + size[last]).tolist(), strict=True)]
                        cells = [pa.array(texts, pa.binary()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())]
                    pick = pa.array(some)
                    yield pa.RecordBatch.from_arrays([flat.field("key").take(pick), flat.field("content").take(pick), ids.take(pa.array(row[some] + w.row0)), flat.field("last").take(pick), *cells], names)

    return run


def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, their numbers, their hashes) of texts of words joined by one space; equal numbers are equal words."""
    data, off = T.raw(column)
    inside = data != 0x20
    starts, ends, first = T.runs(inside, off)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes())])
    body = np.zeros(len(data) + 8, np.uint8)
    body[: len(data)] = data
    return np.diff(first), np.asarray(letters.dictionary_encode().indices).astype(np.int64), T.word_lanes(body, starts, ends)[0]


def _compare(engine: Engine, chunk_words: int):
    """Run the engine over whole keys, as many at a time as a chunk holds; a text with later holders takes part for the last of them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            key, owner = np.asarray(t["key"]), np.asarray(t["owner"])
            lengths, numbers, hashes = numbered(t["words"].combine_chunks())
            again = np.flatnonzero(np.asarray(t["last"].is_valid()))
            of = np.concatenate([np.arange(len(key)), again])
            who = np.concatenate([owner, np.asarray(t["last"].take(pa.array(again)))])
            copy = np.arange(len(of)) >= len(key)
            order = np.lexsort((copy, who, key[of]))
            of, who, copy = of[order], who[order], copy[order]
            n = lengths[of]
            word = np.arange(n.sum()) + np.repeat((np.cumsum(lengths) - lengths)[of] - (np.cumsum(n) - n), n)
            hit, start, windows, other = engine(n, who, key[of], numbers[word], hashes[word])
            pick = pa.array(of[hit])
            return pa.RecordBatch.from_arrays(
                [t["key"].take(pick).combine_chunks(), t["content"].take(pick).combine_chunks(), pa.array(copy[hit]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(other)],
                ["key", "content", "copy", "start", "windows", "other"],
            )

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(h["words"].nbytes for h in held) < 8 * chunk_words:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = np.asarray(t["key"])
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield settle(t.slice(0, last))
            held = [t.slice(last)]
        if held and sum(map(len, held)):
            yield settle(pa.concat_tables(held))

    return run


def repeated_spans(docs: DataFrame, engine: Engine, window: int = WINDOW, gram: int = GRAM, max_texts: int = MAX_TEXTS, chunk_words: int = 1 << 18, least_other: bool = False) -> DataFrame:
    """(doc_id, text_key, start, windows, other): runs of repeated windows, with a smaller document that has them.

    Runs of a document may touch or overlap; ``start`` counts words from 0. Only rows
    with a doc_id take part. ``docs`` needs doc_id and text. ``least_other`` adds, for copies of a
    text as for its first holder, the windows that still smaller documents have.
    """
    cand = candidate_pieces(docs, window, gram)
    least = F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("first")
    firsts = cand.groupBy("key", "content").agg(least, F.max("doc_id").alias("last"))
    texts = stored(firsts.select("key", "content", "first.*", F.when(F.col("last") > F.col("first.doc_id"), F.col("last")).alias("last")), "texts")
    hot_keys = stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_texts).select("key", F.lit(True).alias("hot")), "hot")
    texts = texts.join(hot_keys, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    wants = texts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "content", "start", "windows", "last", "hot")).alias("wants"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    cut = stored(rows.join(wants, ["doc_id", "text_key"]).mapInArrow(_cut(window), CUT), "cut")
    words = cut.filter("words is not null").select("key", "content", "owner", "last", "words")
    dealt = words.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "owner", "content")
    compared = dealt.mapInArrow(_compare(engine, chunk_words), "key long, content binary, copy boolean, start int, windows int, other long")
    hashes = cut.filter("words is null").select("key", "content", "owner", "start", "hash")
    least = stored(hashes.groupBy("hash").agg(F.min("owner").alias("other"), F.max("owner").alias("last")).filter("other < last").drop("last"), "owners")
    whose = F.explode(F.array(F.lit(False), F.lit(True))) if least_other else F.lit(False)
    met = hashes.join(least, "hash").filter("other < owner").select("key", "content", whose.alias("copy"), "start", F.lit(1).alias("windows"), "other")
    found = stored(compared.unionByName(met), "found").withColumnsRenamed({"start": "at", "windows": "n"})
    owners = texts.select("key", "content", F.col("doc_id").alias("owner"), "hot")
    held = cand.join(owners, ["key", "content"]).withColumn("copy", F.col("doc_id") > F.col("owner"))
    copies = held.filter("hot and copy").select("doc_id", "text_key", "start", "windows", F.col("owner").alias("other"))
    by_engine = held.join(found, ["key", "content", "copy"]).select("doc_id", "text_key", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("windows"), "other")
    return copies.unionByName(by_engine)


def cover(counts: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words some spans cover, over rows with ``counts`` words each, laid end to end."""
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    delta = np.zeros(first[-1] + 1, np.int64)
    np.add.at(delta, first[row] + start, 1)
    np.add.at(delta, first[row] + start + length, -1)
    return np.cumsum(delta[:-1]) > 0
