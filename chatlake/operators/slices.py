"""Order within very large chats: slices of time, so that a chat is many tasks' work.

Messages are ordered by time first, so the hours of a chat follow each other. A slice's rows are sorted by themselves, and what came before it is carried
over from a small table with one row a (chat, hour): how many rows, and the last and first of them that matter. That table alone is
windowed by chat. Only the rows of one hour of a chat come together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS = 3600
#: The slice of messages without a time, which come first.
TIMELESS = -(1 << 62)


def slice_of(ts: Column, seconds: int = SECONDS) -> Column:
    return F.coalesce(F.floor(ts / seconds), F.lit(TIMELESS))


def with_starts(slices: DataFrame) -> DataFrame:
    """(chat, slice, n, ...) with ``start``: how many rows the chat has before the slice."""
    before = Window.partitionBy("chat").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def counted(messages: DataFrame) -> DataFrame:
    """(chat, slice, n, start) of ``messages``."""
    return with_starts(messages.groupBy("chat", slice_of(F.col("ts")).alias("slice")).agg(F.count(F.lit(1)).alias("n")))


def around(slices: DataFrame, anchored: DataFrame, before: int, after: int) -> DataFrame:
    """Those of ``slices`` that can hold a row up to ``before`` rows ahead of one in an anchored slice (chat, slice), or ``after`` rows behind it."""
    marked = slices.join(anchored.select("chat", "slice").distinct().withColumn("_own", F.lit(True)), ["chat", "slice"], "left")
    by = Window.partitionBy("chat").orderBy("slice")
    end = F.last(F.when(F.col("_own"), F.col("start") + F.col("n")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(F.when(F.col("_own"), F.col("start")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    near = marked.withColumns({"_end": end, "_next": following})
    wanted = F.col("_own") | (F.col("start") - F.col("_end") < after) | (F.col("_next") - (F.col("start") + F.col("n")) < before)
    return near.filter(wanted).select("chat", "slice", "n", "start")


def numbered(messages: DataFrame, slices: DataFrame, *order: str) -> DataFrame:
    """The rows of ``messages`` in ``slices`` with ``rn``, their place in the whole chat."""
    rows = messages.withColumn("slice", slice_of(F.col("ts"))).join(slices.select("chat", "slice", "start"), ["chat", "slice"])
    nth = F.row_number().over(Window.partitionBy("chat", "slice").orderBy(*order))
    return rows.withColumn("rn", nth + F.col("start")).drop("slice", "start")
