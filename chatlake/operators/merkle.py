"""Change detection that sees every edit: a hash tree over ranges of each shard's numbers in each chat.

A leaf stands for 2 ** bits consecutive numbers of a (chat, shard) and holds how many rows there are and sums of their hashes, which
don't depend on the order of adding, so tasks add up their own rows first. A node above holds its 2 ** fan children's sums. Two trees are compared from
the top: only children of nodes that differ are looked at, so what is read of a stored tree grows with what changed.

Whatever the size of a chat, no task has more than a leaf's rows to combine at once. A null number or shard is a range of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, FAN, LEVELS = 10, 5, 5
SUMS = ("n", "s0", "s1", "s2", "s3")


def _halves(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row in halves, so that sums of any number of rows fit."""
    body = F.to_json(F.struct(*columns))  # nulls and their places are kept apart by the field names
    return [part for seed in (11, 12) for part in (F.shiftrightunsigned(F.xxhash64(F.lit(seed), body), 32), F.xxhash64(F.lit(seed), body).bitwiseAND(0xFFFFFFFF))]


def tree(rows: DataFrame, columns: Sequence[str], bits: int = BITS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(level, chat, db, node, n, s0 ... s3) of all levels; level 0 are the leaves, and the top is one node a (chat, shard).

    ``rows`` has chat, db, local_id and ``columns``, whose values a change is told by.
    """
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"s{k}") for k, h in enumerate(_halves(["local_id", *columns]))]]
    level = rows.groupBy("chat", "db", F.shiftright("local_id", bits).alias("node")).agg(*sums)
    out = level.select(F.lit(0).alias("level"), "*")
    for k in range(1, levels):
        up = F.shiftright("node", fan) if k < levels - 1 else F.lit(0).cast("long")
        level = level.groupBy("chat", "db", up.alias("node")).agg(*[F.sum(c).alias(c) for c in SUMS])
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def write_tree(nodes: DataFrame, path: str) -> None:
    """Store a tree by level, so that a comparison opens the levels it comes to."""
    nodes.write.mode("overwrite").partitionBy("level").parquet(path)


def changed_ranges(before: DataFrame, now: DataFrame, bits: int = BITS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(chat, db, lo, hi, status) of the ranges of numbers whose rows differ: new, gone or changed."""
    sides = before.select("*", F.lit(True).alias("_old")).unionByName(now.select("*", F.lit(False).alias("_old")))
    differing = None
    for k in range(levels - 1, -1, -1):
        nodes = sides.filter(F.col("level") == k)
        if differing is not None:  # each level is asked for once, so the plan grows by a join a level
            up = F.shiftright("node", fan) if k < levels - 2 else F.when(F.lit(k == levels - 2), F.lit(0).cast("long"))
            nodes = nodes.withColumn("_up", up)
            top = differing.select(*[F.col(c).alias(f"_{c}") for c in ("chat", "db", "node")])
            nodes = nodes.join(top, nodes["chat"].eqNullSafe(top["_chat"]) & nodes["db"].eqNullSafe(top["_db"]) & nodes["_up"].eqNullSafe(top["_node"]), "left_semi")
        of = lambda old: F.max(F.when(F.col("_old") == old, F.struct(*SUMS)))  # noqa: E731  there is one a side
        both = nodes.groupBy("chat", "db", "node").agg(of(True).alias("b"), of(False).alias("a")).filter(~F.col("b").eqNullSafe(F.col("a")))
        differing = both.select("chat", "db", "node", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").otherwise("changed").alias("status"))
    lo = F.shiftleft("node", bits)
    return differing.select("chat", "db", lo.alias("lo"), (lo + (1 << bits) - 1).alias("hi"), "status")


def in_ranges(rows: DataFrame, ranges: DataFrame, bits: int = BITS, inside: bool = True) -> DataFrame:
    """The rows of ``rows`` in, or outside, the ranges (chat, db, lo)."""
    r = ranges.select(F.col("chat").alias("_chat"), F.col("db").alias("_db"), F.shiftright("lo", bits).alias("_node")).distinct()
    same = rows["chat"].eqNullSafe(r["_chat"]) & rows["db"].eqNullSafe(r["_db"]) & F.shiftright(rows["local_id"], bits).eqNullSafe(r["_node"])
    return rows.join(r, same, "left_semi" if inside else "left_anti")


def rebuilt(stored: DataFrame, now: DataFrame, ranges: DataFrame, bits: int = BITS) -> DataFrame:
    """``stored`` with the rows in ``ranges`` taken from ``now``; all other rows stay as they are stored."""
    return in_ranges(stored, ranges, bits, inside=False).unionByName(in_ranges(now, ranges, bits).select(*stored.columns))
