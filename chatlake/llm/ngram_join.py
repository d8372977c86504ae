"""N-gram Jaccard join: exact links between shingle sets, as components of documents.

Documents with one shingle set are one class. Sets that can be linked share a
token among the first few of each in one global order (prefix filter), so classes meet
by such tokens, in groups of those that share a token with the same first document.
Tokens that many documents have come last in the order, so they bring documents
together only where nothing rarer can. Signature trees are traversed twice
(``signature_tree``): over each group with sizes and bitmaps alone, which leaves few
possible links, and over each component of those with whole sets, which settles them;
so a set travels once. A group too large for a task is cut into blocks, and pairs of
blocks are compared, each in a task of its own; no pair is left out.

A shingle's identity is 128 bits, two keyed lanes of its words' bytes (``text``); sizes and
intersections count by both, and one set of shingles is told by a BLAKE2 digest of them.
Lane one alone orders tokens and fills bitmaps, which only bring sets together. Tokens that
are common are counted by size first, so that no task gathers the documents of one.

Defined cases: a null or empty text has an empty set and no links; a text of fewer
words than a shingle is one shingle; a null doc_id is linked with nothing and its
component is null; rows sharing a doc_id are one node; an empty table gives an empty
result; other columns of the input are carried by ``keep_one_per_group``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm import text as T
from chatlake.llm.components import components
from chatlake.llm.scratch import partitions, stored
from chatlake.llm.signature_tree import SignatureTree, bitmap, chains

SHINGLE = 5
PERCENT = 80
#: A token is common if this share of documents has it: at most COMMON times the mean set size are.
COMMON = 400
#: Of a block: sets that meet by bitmaps, and tokens of sets that meet whole.
GROUP_SETS, GROUP_TOKENS = 4000, 2_000_000


def shingles(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the distinct shingles of each row, sorted, end to end, and the offsets of the rows."""
    n = np.diff(w.first)
    row = w.row_of()
    inside = row[: max(0, len(row) - k + 1)] == row[k - 1 :]
    short = np.flatnonzero((n > 0) & (n < k))
    rows = np.concatenate([row[: len(inside)][inside], short])
    lanes = []
    for lane, own in enumerate((w.hashes, w.second)):
        alone = np.zeros(len(short), np.uint64)
        for m in range(1, k):
            some = n[short] == m
            alone[some] = T.grams(own, m, lane)[w.first[short[some]]] if some.any() else 0
        lanes.append(np.concatenate([T.grams(own, k, lane)[inside], T.mix(alone + np.uint64(1))]))
    order = np.lexsort((lanes[1], lanes[0], rows))
    rows, one, two = rows[order], lanes[0][order], lanes[1][order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    rows = rows[new]
    return one[new], two[new], np.searchsorted(rows, np.arange(w.rows + 1))


def set_bytes(one: np.ndarray, two: np.ndarray) -> bytes:
    """A set's shingles, lane one before lane two, little-endian."""
    return np.concatenate([one, two]).tobytes()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens of a set of n hold one of every set that can be linked to it."""
    return n - (percent * n + 99) // 100 + 1


def _lists(off: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def _signatures(k: int):
    """Size and digest of each row's set; and, with a null doc_id and size -1, tokens that are common in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "h1", "h2"]
        for b in batches:
            every = []
            for w in T.words(b.column("text"), lower=True):
                one, two, off = shingles(w, k)
                told = b"".join(T.digest(set_bytes(one[i:j], two[i:j])) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                h = np.frombuffer(told, np.int64).reshape(-1, 2)
                every.append(one)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.row0, w.rows), pa.array(np.diff(off)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names)
            tokens, count = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
            often = count >= max(2, len(b.column("doc_id")) // COMMON)
            tokens, count = tokens[often], count[often]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(np.full(len(tokens), -1)), pa.array(tokens.view(np.int64)), pa.array(count)], names)

    return run


def _prefixes(k: int, percent: int, common: np.ndarray):
    """Size, bitmap and prefix of each row's set; a prefix is in order of hash, its ``n_late`` common tokens last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in T.words(b.column("text"), lower=True):
                tokens, _, off = shingles(w, k)
                n = np.diff(off)
                row = np.repeat(np.arange(w.rows), n)
                late = np.isin(tokens, common)
                order = np.lexsort((tokens, late, row))
                place = np.arange(len(tokens)) - np.repeat(off[:-1], n)
                keep = place < np.repeat(prefix_length(n, percent), n)
                out = tokens[order][keep]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=w.rows))])
                n_late = np.bincount(row[keep], late[order][keep], minlength=w.rows)
                bits = [bitmap(tokens[off[i] : off[i + 1]]) if n[i] else None for i in range(w.rows)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(w.row0, w.rows), pa.array(n.astype(np.int64)), pa.array(bits, pa.binary()), _lists(ends, out), pa.array(n_late.astype(np.int32))],
                    ["doc_id", "n", "bits", "prefix", "n_late"],
                )

    return run


def _meet(percent: int):
    """A partition of (token, n, doc), in that order, to (home, doc).

    Documents with one token form chains of sizes that can be linked; home is the first document of such a chain.
    Only the chain that a batch ends in is carried to the next batch, by its home and last size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # token, last size, home, whether home is told already
        for b in batches:
            if not b.num_rows:
                continue
            token, n, doc = (np.asarray(b.column(c)) for c in ("token", "n", "doc_id"))
            head = np.append(True, (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:]))
            goes_on = carried is not None and carried[0] == token[0] and 100 * carried[1] >= percent * n[0]
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(token)))
            home, known = doc[at], np.zeros(len(at), bool)
            if goes_on:
                home[0], known[0] = carried[2], True
            homes = np.repeat(home, size)
            out = [(homes[homes != doc], doc[homes != doc])]
            joined = np.zeros(len(at), bool)
            np.logical_or.at(joined, np.repeat(np.arange(len(at)), size)[homes != doc], True)
            told = known & (carried[3] if goes_on else False)
            fresh = home[joined & ~told]
            out.append((fresh, fresh))
            carried = (token[-1], n[-1], home[-1], bool(joined[-1] or told[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["home", "doc_id"])

    return run


def met_by_common(tokens: DataFrame, percent: int) -> DataFrame:
    """The same for common tokens: chains are found among their few sizes, and documents then join their chain's home by token and size."""
    sizes = tokens.groupBy("token", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    w = Window.partitionBy("token").orderBy("n")
    head = F.coalesce(100 * F.lag("n").over(w) < percent * F.col("n"), F.lit(True))
    chained = sizes.withColumn("head", head.cast("int")).withColumn("chain", F.sum("head").over(w))
    own = Window.partitionBy("token", "chain")
    homes = chained.withColumns({"home": F.min("least").over(own), "last": F.max("most").over(own)}).filter("home < last").select("token", "n", "home")
    return tokens.join(stored(homes, "homes_of_common"), ["token", "n"]).select("home", "doc_id")


def _whole(k: int):
    """Both lanes of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [b.column(c) for c in ("doc_id", "home", "blocks")]
            for w in T.words(b.column("text"), lower=True):
                one, two, off = shingles(w, k)
                sets = pa.array([set_bytes(one[off[i] : off[i + 1]], two[off[i] : off[i + 1]]) for i in range(w.rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(w.row0, w.rows) for c in rest), pa.array(np.diff(off).astype(np.int64)), sets], ["doc_id", "home", "blocks", "n", "body"])

    return run


def in_blocks(rows: DataFrame) -> DataFrame:
    """(home, block_a, block_b, block, doc_id, n, body): each row once for every pair of blocks that its own is in."""
    own = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b")))
    dealt = own.withColumn("p", F.explode(pairs)).select("home", F.col("p.a").alias("block_a"), F.col("p.b").alias("block_b"), "block", "doc_id", "n", "body")
    by = ["home", "block_a", "block_b"]
    return dealt.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "doc_id")


def _link(percent: int, exact: bool):
    """A partition of ``in_blocks`` to links (a, b) that connect what is connected in each block pair."""

    def settle(crossing: bool, docs: list[int], blocks: list[int], sizes: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
        out = []
        for chain in chains(sizes, percent):
            if len(chain) < 2:
                continue
            sets = [np.frombuffer(bodies[i], np.uint64).reshape(2, -1) for i in chain] if exact else None
            bits = [bitmap(s[0]) for s in sets] if exact else [bodies[i] for i in chain]
            roots = SignatureTree([sizes[i] for i in chain], bits, percent, sets).connect([blocks[i] for i in chain] if crossing else None)
            out += [(docs[i], docs[chain[r]]) for i, r in zip(chain, roots, strict=True) if docs[i] != docs[chain[r]]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        links: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for x in batches:
            c = [x.column(n).to_pylist() for n in ("home", "block_a", "block_b", "doc_id", "block", "n", "body")]
            for home, one, two, *row in zip(*c, strict=True):
                if (home, one, two) != key:
                    if key:
                        links += settle(key[1] != key[2], *held)
                    key, held = (home, one, two), ([], [], [], [])
                for cells, value in zip(held, row, strict=True):
                    cells.append(value)
            if len(links) > 50_000:
                yield batch()
                links.clear()
        if key:
            links += settle(key[1] != key[2], *held)
        yield batch()

    return run


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are all pairs with Jaccard similarity >= percent / 100."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    found = stored(texts.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, h1 long, h2 long"), "signatures")
    sizes = found.filter("n_shingles >= 0")
    least = max(16, sizes.count() // COMMON)
    common = found.filter("n_shingles < 0").groupBy("h1").agg(F.sum("h2").alias("n")).filter(F.col("n") >= least)
    # Bounded: a token counts only where a batch has it in 1 of COMMON rows, so at most COMMON times the mean set size of a batch pass.
    late = np.array(sorted(r[0] for r in common.select("h1").collect()), np.int64).view(np.uint64)

    linkable = sizes.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(linkable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "classes")
    firsts = stored(classes.groupBy(F.col("first").alias("doc_id")).agg(F.max("n_shingles").alias("n")), "firsts")
    prefixes = stored(texts.filter("doc_id is not null").mapInArrow(_prefixes(shingle, percent, late), "doc_id long, n long, bits binary, prefix array<long>, n_late int").filter("n > 0"), "prefixes")
    first = prefixes.join(firsts.select("doc_id"), "doc_id")
    n_rare = F.size("prefix") - F.col("n_late")
    rare = first.select("doc_id", "n", F.explode(F.slice("prefix", 1, n_rare)).alias("token"))
    often = first.filter("n_late > 0").select("doc_id", "n", F.explode(F.slice("prefix", n_rare + 1, F.col("n_late"))).alias("token"))
    dealt = rare.repartition(partitions(spark), "token").sortWithinPartitions("token", "n", "doc_id")
    met = dealt.mapInArrow(_meet(percent), "home long, doc_id long").unionByName(met_by_common(often, percent))
    met = stored(met.distinct(), "met")
    homes = met.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).alias("blocks"))
    groups = met.join(stored(homes, "homes"), "home")
    signed = groups.join(prefixes.select("doc_id", "n", F.col("bits").alias("body")), "doc_id")
    possible = stored(in_blocks(signed).mapInArrow(_link(percent, False), "a long, b long"), "possible")

    group = components(possible).withColumnsRenamed({"node": "doc_id", "component": "home"})
    of_size = stored(group.join(firsts, "doc_id"), "grouped")
    loads = of_size.groupBy("home").agg(F.greatest(F.ceil(F.count("n") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("blocks"))
    wanted = of_size.join(stored(loads, "loads"), "home").select("doc_id", "home", "blocks")
    sets = texts.join(wanted, "doc_id").mapInArrow(_whole(shingle), "doc_id long, home long, blocks long, n long, body binary").filter("n > 0")
    links = stored(in_blocks(sets).mapInArrow(_link(percent, True), "a long, b long"), "links")

    same = linkable.join(classes.filter("first < last"), ["h1", "h2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found_in = components(links.unionByName(same)).withColumnRenamed("node", "doc_id")
    return sizes.join(found_in, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that a smaller doc_id of their component stands for; rows repeating the kept doc_id stay."""
    gone = jaccard_components(docs, shingle, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + 3), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS pos FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), own AS (
  SELECT min(doc_id) AS first, list(doc_id) AS members, n.n FROM (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS body FROM g GROUP BY doc_id) JOIN n USING (doc_id) GROUP BY body, n.n
), fg AS (
  SELECT g.doc_id, gram, own.n FROM g JOIN own ON own.first = g.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM fg a JOIN fg b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
), reach(a, b) AS (
  SELECT first, first FROM own UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT unnest(own.members) AS doc_id, least(comp.component_id, own.first) AS component_id FROM own JOIN comp ON comp.a = own.first) m ON m.doc_id = d.doc_id
"""
