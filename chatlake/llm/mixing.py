"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target ratio r is taken floor(r) times, and once more
with probability r - floor(r). Which documents get the extra copy is decided by the
cube method: fractional probabilities of a block of one source's documents move
through the null space of the balancing constraints (token total and document
total) until at most three of them are still fractional. What is left of all
blocks forms the next, far smaller problem, and so on up to one small landing
problem per source. Blocks are hashed, so a source with a third of all documents
is as many tasks as its size asks for.

Defined cases: a null text has size 0; a null source is a source, the last one;
a source without words has target 0 and takes nothing; rows that repeat a doc_id
are documents of their own; an empty table gives an empty result; ``mixed_documents``
carries all columns of the input, ``mix_sources`` has its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.scratch import free_names, stored

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_RATIO = 2.0
BLOCK_ROWS = 512
TRADES = 4
DEFAULTS = {"weights": WEIGHTS, "share": TOTAL_SHARE, "cap": MAX_RATIO, "seed": 1}
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_RATIO) -> DataFrame:
    """(source, source_size, n_docs, target) from rows with source and size.

    Weights repeat over the sources by code point, null last. A source stops at
    ``cap`` times its size and its excess is shared anew by weight: the level at
    which that ends is found from running sums in the order in which sources fill up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    ranked = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (F.sum("source_size").over(total) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )  # weights are small whole numbers, so that the difference is exact
    leveled = ranked.withColumn("level", level).withColumn("open", F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level")))
    first = F.first("open", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(first * F.col("w"), F.col("most")), F.col("most")))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, balancing their sum and the sum of pi * size.

    Three units at a time have a null space of dimension one under the two
    constraints; a step along it makes one of them certain. At most two stay fractional
    here, or more that no step can move.
    """
    p = pi.tolist()
    order = [int(i) for i in rng.permutation(len(p)) if 0.0 < p[i] < 1.0]
    draws = iter(rng.random(len(order) + 1).tolist())
    s = size.tolist()
    hand, rest = [], iter(order)
    for i in rest:
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])  # sums to 0, and so does u * size
        if not any(u):
            u = (1.0, -1.0, 0.0)  # three equal sizes: any exchange keeps both totals
        up = down = math.inf
        for k, x in zip(hand, u, strict=True):
            if x > 0:
                up, down = min(up, (1.0 - p[k]) / x), min(down, p[k] / x)
            elif x < 0:
                up, down = min(up, p[k] / -x), min(down, (1.0 - p[k]) / -x)
        step = up if next(draws) * (up + down) < down else -down
        for k, x in zip(hand, u, strict=True):
            v = p[k] + step * x
            p[k] = 0.0 if v < 1e-9 else 1.0 if v > 1.0 - 1e-9 else v
        hand = [k for k in hand if 0.0 < p[k] < 1.0]
    return np.asarray(p)


def landing(pi: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Settle the last fractional units of ``pi``, which a flight made of ``start``.

    Of all ways to settle them the one nearest to the token total is taken, then to the count; then a
    unit taken and one left out trade places, TRADES times at most, while that comes nearer to the token total.
    """
    p, goal = pi.copy(), float((start * size).sum())
    left = np.flatnonzero((p > 0) & (p < 1))
    while len(left) > 10:  # units that no step could move: settle the smallest by rounding
        k = left[np.argmin(size[left])]
        p[k] = np.round(p[k])
        left = np.flatnonzero((p > 0) & (p < 1))
    best, fixed, count = None, p.copy(), start.sum()
    fixed[left] = 0
    have = (fixed * size).sum()
    for bits in range(1 << len(left)):
        x = np.array([bits >> i & 1 for i in range(len(left))], float)
        cost = (abs(have + (x * size[left]).sum() - goal), abs(fixed.sum() + x.sum() - count))
        if best is None or cost < best[0]:
            best = (cost, x)
    if best is not None:
        p[left] = best[1]
    for _ in range(TRADES):
        over = (p * size).sum() - goal
        ones, zeros = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not over or not len(ones) or not len(zeros):
            break
        rest = np.abs(over - (size[ones][:, None] - size[zeros][None, :]))
        i, j = np.unravel_index(int(rest.argmin()), rest.shape)
        if rest[i, j] >= abs(over):
            break
        p[ones[i]], p[zeros[j]] = 0.0, 1.0
    return p


def _settle(seed: int):
    """One block's flight, and its landing where the block is all that is open of its source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_key", "size", "row"], kind="stable")
        size, start = pdf["size"].to_numpy(float), pdf["pi"].to_numpy(float)
        mark = int(np.bitwise_xor.reduce(pdf["doc_key"].to_numpy().view(np.uint64)))
        p = flight(start, size, np.random.default_rng([seed, mark & 0xFFFFFFFF, len(pdf)]))
        whole = pdf["n_open"].iloc[0] <= BLOCK_ROWS
        return pdf.drop(columns="block").assign(pi=landing(p, size, start) if whole else p)

    return run


def cube_sample(rows: DataFrame, seed: int = 1) -> DataFrame:
    """``rows`` has row, doc_key, source_key, n_open, size, pi; returns (row, extra 0/1) for all of them.

    Every level treats blocks of about BLOCK_ROWS rows of one source and leaves at
    most two a block; a source that is one block lands there.
    """
    schema = "row long, doc_key long, source_key long, n_open long, size long, pi double"
    names = [c.split()[0] for c in schema.split(", ")]
    todo, done, level = rows, None, 0
    while True:
        if level:
            counts = stored(todo.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_open")), "open")
            if counts.isEmpty():
                break
            todo = todo.drop("n_open").join(counts, "source_key")
        block = F.pmod(F.xxhash64("doc_key", "size", F.lit(seed + level)), F.ceil(F.col("n_open") / BLOCK_ROWS)).alias("block")
        out = stored(todo.select(*names, block).groupBy("source_key", "block").applyInPandas(_settle(seed + level), schema), "cube")
        settled = out.filter("pi = 0 or pi = 1").select("row", F.col("pi").cast("int").alias("extra"))
        done = settled if done is None else done.unionByName(settled)
        todo, level = out.filter("pi > 0 and pi < 1"), level + 1
    return done


def sized(rows: DataFrame, row: str) -> DataFrame:
    """One narrow row per document: row (its number, in the column ``row``), doc_id, source, size."""
    return stored(rows.select(F.col(row).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_RATIO, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    rows = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    return _mix(sized(rows, "row"), weights, share, cap, seed).drop("row")


def _mix(sizes: DataFrame, weights, share, cap, seed) -> DataFrame:
    targets = stored(source_targets(sizes, weights, share, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_source"), "source_size", "n_docs", "target", ratio.alias("ratio"))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("ratio") + 1e-12)
    rows = rows.withColumns({"copies": whole.cast("long"), "pi": F.greatest(F.col("ratio") - whole, F.lit(0.0))})
    open_ = rows.filter((F.col("pi") > 1e-12) & (F.col("size") > 0)).select(
        "row", F.xxhash64("doc_id", "size").alias("doc_key"), F.xxhash64("source").alias("source_key"), F.col("n_docs").alias("n_open"), "size", "pi"
    )
    extra = cube_sample(open_, seed)
    out = rows.join(extra, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("extra", F.lit(0)))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, each row repeated as often as it is taken, with all its columns.

    Rows are numbered in a stored table, so that equal rows stay apart and texts are shuffled once, by row.
    """
    row, copies, k = free_names(docs.columns, "_row", "_copies", "_k")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = _mix(sized(rows, row), **{**DEFAULTS, **parameters}).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    each = rows.join(taken, row)
    return each.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

