"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of BITS bits, the sides of random hyperplanes
through a centre, and keeps the strings in a sorted array, where a prefix is a range. A query
descends every tree to its longest matching prefix and then ascends all trees together,
one bit at a time. Bits of two vectors at an angle t agree with probability 1 - t / pi, so
at every depth it is known how likely a vector at the angle of the k-th nearest one found
so far would have been met by now; ascent ends when that is SURE. In clustered data that is
after a few ranges; where neighbours hardly stand out, it goes on through much of the table.

The index is dealt by the first bits of one more string, the route, into shards of about
SHARD vectors; a route that more vectors share is dealt on by their hash, into shards of its
own. A query first searches the shards of its own route. The angle of its k-th nearest there
tells how likely each bit of a nearer neighbour's route differs from its own, and it goes on
to the likeliest other routes until they hold such a neighbour with probability ROUTED. A
query whose neighbours can't be told to lie in few routes goes to all of them, so no row is
out of reach. Every range is taken whole, so equal vectors are candidates together and ties
fall to the smaller id. The centre is the mean of at most SAMPLE vectors.

Defined cases: vectors null, empty, zero or with null or non-finite components take no
part, as queries or candidates, nor do null vec_ids; vectors of another length than the query's are
no candidates; rows sharing the query's vec_id are not its candidates; equal rows are
one; fewer than k candidates give fewer rows; an empty table gives none; other columns are
not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.embedding_dedup import matrix, usable
from chatlake.llm.scratch import partitions, stored

TREES, BITS = 256, 32
SURE, ROUTED = 0.93, 0.98
SHARD, SAMPLE = 8192, 4096
#: Route bits whose flips are looked at together; 2 ** FLIPS routes a query at most, before it goes to all.
FLIPS = 12
STEPS = 8
SEED = 11


def normals(dim: int, n: int, salt: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dim, salt]).normal(size=(dim, n)).astype(np.float32)


def agreement(cosine: np.ndarray) -> np.ndarray:
    """The probability that one bit of two vectors agrees."""
    return 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / math.pi


class HashForest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, centre: np.ndarray, trees: int = TREES) -> None:
        self.x, self.ids, self.centre, self.trees = x, ids, centre, trees
        self.planes = normals(x.shape[1], trees * BITS)
        codes = self.strings(x)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)
        self.read = 0

    def strings(self, x: np.ndarray) -> np.ndarray:
        """One string per tree and row."""
        out = np.empty((self.trees, len(x)), np.int64)
        for i in range(0, len(x), 512):
            side = (x[i : i + 512] - self.centre).astype(np.float32) @ self.planes > 0
            out[:, i : i + 512] = np.packbits(side, axis=1).view(">u4").T
        return out

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the range of the sorted array that has the query's prefix of ``length`` bits."""
        cut = BITS - length
        low = np.empty(codes.shape, np.int64)
        high = np.empty_like(low)
        for t in range(self.trees):
            first = codes[t] >> cut << cut
            low[t], high[t] = np.searchsorted(self.sorted[t], first, "left"), np.searchsorted(self.sorted[t], first + (1 << cut), "left")
        return low, high

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(query, rows, distances, agreement of the k-th) of each query's k nearest found; ``bound`` is an agreement known before, or nan."""
        codes = self.strings(queries)
        seen = [np.zeros(0, np.int64)] * len(queries)
        open_ = np.arange(len(queries))
        begun = np.zeros(len(queries), bool)  # all ranges one bit deeper are read
        for length in range(BITS, -1, -1):
            # A query that knows how near its neighbours must be starts where that can end its search.
            ready = open_[~((1 - (1 - bound[open_] ** max(0, length - 1)) ** self.trees) < SURE)]
            if not len(ready):
                continue
            low, high = self.ranges(codes[:, ready], length)
            done = []
            for at, q in enumerate(ready):
                if np.isnan(bound[q]) and length and (high[:, at] - low[:, at]).sum() <= k:
                    continue
                for step in range(STEPS):
                    some = range(step, self.trees, STEPS)
                    parts = [self.order[t, low[t, at] : high[t, at]] for t in some]
                    seen[q] = np.unique(np.concatenate([seen[q], *parts]))
                    rows, score = self._nearest(queries[q], own[q], seen[q], k)
                    p = bound[q]
                    if len(rows) >= k:
                        found = self._agreement(queries[q], rows[-1])
                        p = found if np.isnan(p) else max(p, found)
                    before = self.trees * (step + 1) // STEPS
                    deeper = (1 - p ** (length + 1)) ** (self.trees - before) if begun[q] else 1.0
                    missed = 1.0 if np.isnan(p) else (1 - p**length) ** before * deeper
                    if 1 - missed >= SURE or (not length and step == STEPS - 1):
                        done.append(q)
                        self.read += len(seen[q])
                        yield q, rows, score, (self._agreement(queries[q], rows[-1]) if len(rows) >= k else math.nan)
                        break
                begun[q] = True
            open_ = np.setdiff1d(open_, done)

    def _agreement(self, query: np.ndarray, row: int) -> float:
        a, b = query - self.centre, self.x[row] - self.centre
        return float(agreement(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b) + 1e-300)))

    def _nearest(self, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact distances of the k nearest of ``rows``, ties to smaller ids, ``own`` left out."""
        rows = rows[self.ids[rows] != own]
        square = ((self.x[rows] - query) ** 2).sum(axis=1)
        if len(rows) > k:
            near = square <= np.partition(square, k - 1)[k - 1]
            rows, square = rows[near], square[near]
        score = np.sqrt(square)
        order = np.lexsort((self.ids[rows], score))[:k]
        return rows[order], score[order]


def _centre(centres: dict[int, list[float]], dim: int) -> np.ndarray:
    return np.array(centres.get(dim, [0.0] * dim))


def _routes(bits: int, centres: dict[int, list[float]]):
    """Each vector's route, as a number of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column("embedding").value_lengths())
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                side = (matrix(part.column("embedding")) - _centre(centres, dim)).astype(np.float32) @ normals(dim, bits, 1) > 0
                route = side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(route)], [*part.schema.names, "route"])

    return run


def likely_routes(query: np.ndarray, planes: np.ndarray, agree: float) -> tuple[np.ndarray, float]:
    """Flip masks of routes, the likeliest first and the query's own left out, until a neighbour whose bits agree with ``agree`` is in one of them; and that probability."""
    bits, dim = planes.shape[1], len(query)
    angle = (1 - agree) * math.pi
    unit = query / (math.sqrt(query @ query) + 1e-300)
    margin = np.abs(unit @ planes) / np.linalg.norm(planes, axis=0)
    spread = np.sqrt(np.maximum(1 - margin**2, 1e-12) / max(1, dim - 1))
    flip = np.array([0.5 * math.erfc(math.cos(angle) * m / (max(math.sin(angle), 1e-9) * s * math.sqrt(2))) for m, s in zip(margin, spread, strict=True)])
    open_ = np.argsort(-flip)[:FLIPS]
    mask, chance = np.zeros(1, np.int64), np.array([np.prod(1 - np.delete(flip, open_))])
    for j in open_:
        mask, chance = np.concatenate([mask, mask | 1 << int(j)]), np.concatenate([chance * (1 - flip[j]), chance * flip[j]])
    order = np.argsort(-chance, kind="stable")
    total = np.cumsum(chance[order])
    n = int(np.searchsorted(total, ROUTED)) + 1
    picked = mask[order[:n]]
    return picked[picked != 0], float(total[min(n, len(total)) - 1])


def _onward(bits: int, centres: dict[int, list[float]]):
    """Queries with the routes they still have to visit; null for all but their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            agree, route = np.asarray(b.column("agree").fill_null(math.nan)), np.asarray(b.column("route"))
            for i, v in enumerate(b.column("embedding").to_pylist()):
                if math.isnan(agree[i]):
                    out.append(None)
                    continue
                masks, chance = likely_routes(np.array(v) - _centre(centres, len(v)), normals(len(v), bits, 1).astype(float), agree[i])
                out.append((route[i] ^ masks).tolist() if chance >= ROUTED else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "next"])

    return run


FOUND = "query long, query_id long, vec_id long, score double, agree double"


def _search(k: int, centres: dict[int, list[float]], trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, forest = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("dim", "route", "salt", "is_query")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part, now = b.slice(i, j - i), tuple(keys[i][:3].tolist())
                if now != key:
                    key, index, forest = now, [], None
                if not keys[i][3]:
                    index.append((np.asarray(part.column("vec_id")), matrix(part.column("embedding"))))
                    continue
                if not index:
                    continue
                if forest is None:
                    ids, x = np.concatenate([p[0] for p in index]), np.concatenate([p[1] for p in index])
                    forest = HashForest(x, ids, _centre(centres, now[0]), trees)
                queries, who, node = matrix(part.column("embedding")), np.asarray(part.column("vec_id")), np.asarray(part.column("node"))
                bound = np.asarray(part.column("agree").fill_null(math.nan)).copy()
                for at in range(0, len(queries), 256):
                    out = [[], [], [], [], []]
                    for q, rows, score, agree in forest.search(queries[at : at + 256], who[at : at + 256], k, bound[at : at + 256]):
                        for cells, values in zip(out, (np.full(len(rows), node[at + q]), np.full(len(rows), who[at + q]), forest.ids[rows], score, np.full(len(rows), agree)), strict=True):
                            cells.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], [c.split()[0] for c in FOUND.split(", ")])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row among all other rows of ``vectors``."""
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct()
    rows = good.withColumns({"dim": F.size("embedding"), "query": is_query, "node": F.xxhash64("vec_id", "embedding")})
    sample = stored(rows.select("dim", "embedding", "node").orderBy("node", "dim").limit(SAMPLE), "sample")
    each = sample.select("dim", F.posexplode("embedding").alias("at", "v")).groupBy("dim", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # Bounded: at most SAMPLE vectors' components.
    centres = {r.dim: [c.v for c in sorted(r.c)] for r in each.groupBy("dim").agg(F.collect_list(F.struct("at", "v")).alias("c")).collect()}
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / shard)))
    schema = "vec_id long, embedding array<double>, dim int, query boolean, node long, route long"
    routed = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(_routes(bits, centres), schema)
    rows = stored(routed, "vectors")
    shards = stored(rows.groupBy("dim", "route").agg(F.ceil(F.count(F.lit(1)) / shard).alias("salts")), "shards")
    index = rows.join(shards, ["dim", "route"]).select("dim", "route", F.pmod("node", "salts").alias("salt"), F.lit(0).alias("is_query"), "vec_id", "node", "embedding", F.lit(None).cast("double").alias("agree"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")

    def find(asked: DataFrame) -> DataFrame:
        queries = asked.select("dim", "route", every, F.lit(1).alias("is_query"), "vec_id", "node", "embedding", "agree")
        wanted = index.join(queries.select("dim", "route").distinct(), ["dim", "route"], "left_semi").select(*queries.columns)
        dealt = wanted.unionByName(queries).repartition(partitions(spark), "dim", "route", "salt").sortWithinPartitions("dim", "route", "salt", "is_query", "vec_id")
        return stored(dealt.mapInArrow(_search(k, centres, trees), FOUND), "found")

    queries = rows.filter("query").drop("query")
    at_home = find(queries.withColumn("agree", F.lit(None).cast("double")).join(shards, ["dim", "route"]))
    # Over the shards of its own route, the nearest k-th found bounds the angle of a query's neighbours.
    agree = at_home.filter(~F.isnan("agree")).groupBy(F.col("query").alias("node")).agg(F.max("agree").alias("agree"))
    going = queries.join(stored(agree, "agree"), "node", "left").select("vec_id", "embedding", "dim", "node", "route", "agree")
    going = stored(going.mapInArrow(_onward(bits, centres), "vec_id long, embedding array<double>, dim int, node long, route long, agree double, next array<long>"), "going")
    some = going.filter("next is not null").withColumn("route", F.explode("next")).join(shards, ["dim", "route"])
    others = shards.withColumnRenamed("route", "other")
    rest = going.filter("next is null").join(others, "dim").filter("route <> other").drop("route").withColumnRenamed("other", "route")
    elsewhere = find(some.unionByName(rest.select(*some.columns)))
    # Rows that share a vec_id are candidates on their own; the nearest one speaks for the id.
    best = at_home.unionByName(elsewhere).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
