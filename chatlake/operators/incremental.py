"""Fingerprints, resume state and sync plans between two states of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(messages: DataFrame, kind_number: Column, upto: Column | None = None) -> DataFrame:
    """(chat, cnt, max_id, type_sum), over all rows or those that ``upto`` selects."""
    ok = upto if upto is not None else F.lit(True)
    return messages.groupBy("chat").agg(
        F.count_if(ok).alias("cnt"), F.max(F.when(ok, F.col("local_id"))).alias("max_id"), F.coalesce(F.sum(F.when(ok, kind_number)), F.lit(0)).cast("long").alias("type_sum")
    )


def tail_state(messages: DataFrame) -> DataFrame:
    """(chat, last_ts, n_last): where an export of the rows ends, and how many rows have that time."""
    per = messages.groupBy("chat", "ts").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("chat").agg(F.max("ts").alias("last_ts"), F.max_by("n", "ts").alias("n_last"))


def select_new(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Rows an append export still has to write: later ones, and at the last time those beyond the count; earlier ones are dropped."""
    nth = F.row_number().over(Window.partitionBy("chat", "ts").orderBy("dbr", "local_id"))
    placed = messages.withColumn("nth", nth).join(state, "chat", "left")
    new = F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts")) | ((F.col("ts") == F.col("last_ts")) & (F.col("nth") > F.col("n_last")))
    return placed.filter(new).select(*messages.columns)


def plan_sync(previous: DataFrame, current: DataFrame, prefix: DataFrame) -> DataFrame:
    """(chat, action): skip, append, rebuild or drop, from fingerprints before, now, and now of the ids known before."""
    p = previous.select("chat", F.struct("cnt", "max_id", "type_sum").alias("p"))
    c = current.select("chat", F.struct("cnt", "max_id", "type_sum").alias("c"))
    x = prefix.select("chat", F.struct("cnt", "max_id", "type_sum").alias("x"))
    both = p.join(c, "chat", "full").join(x, "chat", "left")
    action = F.when(F.col("c").isNull(), "drop").when(F.col("p").isNull(), "rebuild").when(F.col("p") == F.col("c"), "skip").when(F.col("p") == F.col("x"), "append").otherwise("rebuild")
    return both.select("chat", action.alias("action"))


def export_totals(new_counts: DataFrame) -> DataFrame:
    """(changed_chats, total_new) over (chat, n)."""
    return new_counts.agg(F.count_if(F.col("n") > 0).alias("changed_chats"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_new"))


def manifest_status(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or missing files by size and time."""
    b = before.select("path", F.struct("mtime", "size").alias("b"))
    n = now.select("path", F.struct("mtime", "size").alias("n"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "missing").when(F.col("b") == F.col("n"), "unchanged").otherwise("changed")
    return b.join(n, "path", "full").select("path", status.alias("status"))
