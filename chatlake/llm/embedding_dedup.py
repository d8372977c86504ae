"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a vector pseudo-randomly (three rounds of random signs and a Hadamard
transform) and takes the nearest of the 2 d signed axes; POLYTOPES of them make a table's
bucket. Besides its bucket a vector probes those with one axis replaced by its second
nearest. Vectors that share any bucket of a table are candidates, and every candidate
pair is verified by its cosine in double precision.

Buckets whose least vector is the same are one group, so that a cluster found in many
tables is compared about once. Groups are compared by matrix products; one too large for
a task is cut into blocks, and pairs of blocks are tasks of their own. A pair in several
groups is counted in the one with the least home, which its rows carry, so links are
counted where they are found and never listed.

Defined cases: a vector that is null, empty, zero or has null or non-finite components
links with nothing (kept, 0 links, its own component); vectors of different lengths are
not compared; equal vectors are one class and count as links of each other; a null
vec_id has no component and isn't kept; rows sharing a vec_id are one node whose links add
up; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.components import components
from chatlake.llm.scratch import partitions, stored

COSINE = 0.9
TABLES = 14
#: So many polytopes make a bucket; a 64-bit key holds three of up to a million axes each.
POLYTOPES = 3
BLOCK, HOMES = 2048, 1024
SEED = 7


def usable(v: Column) -> Column:
    """Whether a vector has only finite components and one that isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def polytope_keys(x: np.ndarray, tables: int, polytopes: int, seed: int = SEED) -> np.ndarray:
    """Bucket keys of unit rows: shape (rows, tables, 1 + polytopes), the row's own bucket first."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, d])
    keys = np.zeros((n, tables, 1 + polytopes), np.uint64)
    at = np.arange(n)
    for t in range(tables):
        axes = np.zeros((2, polytopes, n), np.uint64)
        for k in range(polytopes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            for nth in range(2):
                best = size.argmax(axis=1)
                axes[nth, k] = best * 2 + (y[at, best] < 0)
                size[at, best] = -1.0
        for probe in range(1 + polytopes):
            key = np.full(n, t + 1, np.uint64)
            for k in range(polytopes):
                key = key * np.uint64(2 * d) + axes[int(probe == k + 1), k]
            keys[:, t, probe] = key
    return keys


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _keys(tables: int, polytopes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column("embedding").value_lengths())
            for dim in np.unique(lengths):
                some = pa.array(np.flatnonzero(lengths == dim))
                x = matrix(b.column("embedding").take(some))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = polytope_keys(x, tables, polytopes).reshape(len(x), -1)
                off = np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("node").take(some), pa.array(np.full(len(x), dim, np.int64)), lists], ["node", "dim", "keys"])

    return run


def _verify(least: float):
    """A group's block pair to per-node link counts (b null) and links (a, b) that connect its components."""

    def settle(rows: pa.Table, pair: tuple[int, int]) -> pa.RecordBatch:
        node = np.asarray(rows["node"])
        home = rows["home"][0].as_py()
        x = matrix(rows["embedding"].combine_chunks())
        copies = np.asarray(rows["copies"]).astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        homes = rows["homes"].combine_chunks()
        flat = np.asarray(homes.flatten())
        of = np.repeat(np.arange(len(node)), np.asarray(homes.value_lengths()))
        earlier = flat < home
        names, at = np.unique(flat[earlier], return_inverse=True)
        whose = of[earlier]
        block = np.asarray(rows["block"])
        one, two = (np.flatnonzero(block == p) for p in pair)
        if pair[0] != pair[1] and (not len(one) or not len(two)):
            one = two = one[:0]
        near = np.zeros((len(one), len(two)), bool)
        for i in range(0, len(one), 512):
            a = one[i : i + 512]
            cosine = (x[a] @ x[two].T) / (norm[a][:, None] * norm[two][None, :])
            near[i : i + 512] = (cosine >= least) & (node[a][:, None] != node[two][None, :])
        count = np.zeros(len(node))
        own = near.copy()
        for lo in range(0, len(names), HOMES):  # pairs that an earlier home has are counted there
            part = (at >= lo) & (at < lo + HOMES)
            shared = np.zeros((len(node), HOMES), np.float32)
            shared[whose[part], at[part] - lo] = 1.0
            own &= ~(shared[one] @ shared[two].T > 0)
        np.add.at(count, one, own @ copies[two])
        if pair[0] != pair[1]:
            np.add.at(count, two, own.T @ copies[one])
        a, b = _spanning(near, one, two)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[hit], node[a]])),
                pa.array(np.concatenate([np.zeros(len(hit), np.int64), node[b]]), mask=np.arange(len(hit) + len(a)) < len(hit)),
                pa.array(np.concatenate([count[hit].astype(np.int64), np.zeros(len(a), np.int64)])),
            ],
            ["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("home", "dim", "block_a", "block_b")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                now = tuple(int(v) for v in keys[i])
                if now != key and held:
                    yield settle(pa.concat_tables(held), key[2:])
                    held = []
                key = now
                held.append(pa.Table.from_batches([b.slice(i, j - i)]))
        if held:
            yield settle(pa.concat_tables(held), key[2:])

    return run


def _spanning(near: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few pairs of ``near`` that connect all that it connects: a breadth-first forest over its rows and columns."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    seen_rows, seen_cols = np.zeros(len(one), bool), np.zeros(len(two), bool)
    for r in np.flatnonzero(near.any(axis=1)):
        if seen_rows[r]:
            continue
        seen_rows[r] = True
        rows = np.array([r])
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & ~seen_cols)
            if not len(cols):
                break
            via = rows[near[np.ix_(rows, cols)].argmax(axis=0)]
            a.append(one[via])
            b.append(two[cols])
            seen_cols[cols] = True
            rows = np.flatnonzero(near[:, cols].any(axis=1) & ~seen_rows)
            if len(rows):
                a.append(one[rows])
                b.append(two[cols[near[np.ix_(rows, cols)].argmax(axis=1)]])
                seen_rows[rows] = True
    none = np.zeros(0, np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def near_duplicates(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct().withColumn("h", F.xxhash64("embedding"))
    classes = stored(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    hashed = classes.select("node", "embedding").mapInArrow(_keys(tables, POLYTOPES), "node long, dim long, keys array<long>")
    keys = stored(hashed.select("node", "dim", F.explode(F.array_distinct("keys")).alias("key")), "keys")
    buckets = keys.groupBy("dim", "key").agg(F.min("node").alias("home"), F.max("node").alias("last")).filter("home < last").drop("last")
    met = stored(keys.join(stored(buckets, "buckets"), ["dim", "key"]).select("node", "dim", "home").distinct(), "met")
    blocks = met.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    groups = met.join(stored(blocks, "blocks"), "home").groupBy("node", "dim").agg(F.collect_list(F.struct("home", "blocks")).alias("groups"))
    placed = classes.join(groups, (classes["node"] == groups["node"]) & (F.size("embedding") == groups["dim"])).drop(groups["node"])
    each = placed.withColumn("homes", F.transform("groups", lambda g: g["home"])).select("node", "copies", "embedding", "dim", "homes", F.explode("groups").alias("g"))
    each = each.withColumns({"home": F.col("g.home"), "block": F.pmod(F.xxhash64("node"), F.col("g.blocks"))})
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g.blocks") - 1), lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b")))
    each = each.withColumn("p", F.explode(pairs)).select("home", "dim", F.col("p.a").alias("block_a"), F.col("p.b").alias("block_b"), "block", "node", "copies", "embedding", "homes")
    by = ["home", "dim", "block_a", "block_b"]
    dealt = each.repartition(partitions(spark), *by).sortWithinPartitions(*by, "node")
    found = stored(dealt.mapInArrow(_verify(least), "a long, b long, n long"), "found")

    members = good.join(classes.select("h", "embedding", "node", "copies"), ["h", "embedding"]).select("vec_id", "node", "copies")
    members = stored(members, "members")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = members.join(stored(counts, "counts"), "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    same = members.filter("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    component = components(found.filter("b is not null").select("a", "b").unionByName(same)).withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").join(linked, "vec_id", "left").join(component, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9
), reach(a, b) AS (
  SELECT DISTINCT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT t.vec_id, (SELECT count(*) FROM links WHERE links.a = t.vec_id) AS n_links, coalesce(c.component_id, t.vec_id) AS component_id, coalesce(c.component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN comp c ON c.a = t.vec_id
"""
