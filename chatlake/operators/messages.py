"""Paging, time ranges, context and as-of lookup; one plan serves all chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import parse_message_id
from chatlake.operators import slices

ORDER = ("ts", "dbr", "local_id")


def in_range(c: Column, since, until, half_open: bool = False) -> Column:
    """since <= c <= until for queries; c < until for exports."""
    return (c >= since) & ((c < until) if half_open else (c <= until))


def page(messages: DataFrame, limit: int, before: Column | None = None, after: Column | None = None, from_start: bool = False) -> DataFrame:
    """``limit`` messages of every chat: the last ones, those before or after a cursor, or the first ones.

    ``before`` and ``after`` are structs in the page order; the page itself has ``rn`` from 1, oldest first.
    """
    key = F.struct(*ORDER)
    rows = messages
    if before is not None:
        rows = rows.filter(key < before)
    if after is not None:
        rows = rows.filter(key > after)
    ascending = from_start or after is not None
    way = [F.col(c).asc() if ascending else F.col(c).desc() for c in ORDER]
    picked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("chat").orderBy(*way))).filter(F.col("nth") <= limit)
    return picked.withColumn("rn", F.row_number().over(Window.partitionBy("chat").orderBy(*ORDER))).drop("nth")


def page_flags(messages: DataFrame, paged: DataFrame) -> DataFrame:
    """(chat, has_more_before, has_more_after) of a page within all of ``messages``, the time range, whatever the cursor was."""
    key = F.struct(*ORDER)
    whole = messages.groupBy("chat").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    own = paged.groupBy("chat").agg(F.min(key).alias("p_first"), F.max(key).alias("p_last"))
    return whole.join(own, "chat").select("chat", (F.col("first") < F.col("p_first")).alias("has_more_before"), (F.col("last") > F.col("p_last")).alias("has_more_after"))


def context(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Rows around each anchor (chat, db, local_id): (chat, anchor_db, anchor, db, local_id, distance).

    Of the anchors' chats, only the hours near an anchor are sorted, each by itself (``slices``).
    """
    wanted = anchors.select("chat", "db", "local_id").distinct()
    rows = messages.select("chat", *ORDER, "db")
    chats = rows.join(wanted.select("chat").distinct(), "chat", "left_semi")
    anchored = rows.join(wanted, ["chat", "db", "local_id"], "left_semi").select("chat", slices.slice_of(F.col("ts")).alias("slice"))
    placed = slices.numbered(rows, slices.around(slices.counted(chats), anchored, before, after), *ORDER)
    at = placed.join(wanted, ["chat", "db", "local_id"], "left_semi").select("chat", F.col("db").alias("anchor_db"), F.col("local_id").alias("anchor"), F.col("rn").alias("at"))
    near = at.withColumn("rn", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)))
    return near.join(placed.select("chat", "rn", "db", "local_id"), ["chat", "rn"]).select("chat", "anchor_db", "anchor", "db", "local_id", (F.col("rn") - F.col("at")).alias("distance"))


def as_of(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each probe (chat, ts, dbr, local_id) the last target at or before its time, else the first one after.

    Probes and targets are united and each hour of a chat is sorted once each way, the nearest target so far carried along; an
    hour's ends come from the hours before and after it (``slices``).
    """
    key = "struct<ts:bigint,dbr:int,local_id:bigint>"
    t = targets.select("chat", "ts", "dbr", F.lit(0).alias("is_probe"), "local_id", F.struct("ts", "dbr", "local_id").cast(key).alias("target"))
    p = probes.select("chat", "ts", "dbr", F.lit(1).alias("is_probe"), "local_id", F.lit(None).cast(key).alias("target"))
    both = p.unionByName(t).withColumn("slice", slices.slice_of(F.col("ts")))
    ends = t.groupBy("chat", slices.slice_of(F.col("ts")).alias("slice")).agg(F.max("target").alias("last"), F.min("target").alias("first"))
    hours = ends.unionByName(p.select("chat", slices.slice_of(F.col("ts")).alias("slice"), F.lit(None).cast(key).alias("last"), F.lit(None).cast(key).alias("first")).distinct()).groupBy("chat", "slice").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    by = Window.partitionBy("chat").orderBy("slice")
    carried = hours.select(
        "chat", "slice", F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    )
    order = ("ts", "is_probe", "dbr", "local_id")
    so_far = (Window.unboundedPreceding, 0)
    own = Window.partitionBy("chat", "slice")
    back = F.last("target", ignorenulls=True).over(own.orderBy(*order).rowsBetween(*so_far))
    ahead = F.last("target", ignorenulls=True).over(own.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*so_far))
    found = both.withColumns({"back": back, "ahead": ahead}).filter("is_probe = 1").join(carried, ["chat", "slice"], "left")
    found = found.withColumns({"back": F.coalesce("back", "_before"), "ahead": F.coalesce("ahead", "_after")})
    best = F.coalesce("back", "ahead")
    return found.select("chat", "dbr", "local_id", best["dbr"].alias("target_dbr"), best["local_id"].alias("target_id"), F.col("back").isNull().alias("fell_forward"))


def with_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """``messages`` of the chats in ``cursors`` (chat, cursor as N:local_id) with the sort key of that message of the chat as ``at``; a chat whose cursor is unknown drops out."""
    wanted = cursors.select("chat", parse_message_id(F.col("cursor")).alias("_c")).select("chat", F.col("_c.db").alias("db"), F.col("_c.local_id").alias("local_id"))
    at = messages.join(wanted, ["chat", "db", "local_id"]).select("chat", F.struct(*ORDER).alias("at"))
    return messages.join(at, "chat")


def page_envelope(messages: DataFrame, paged: DataFrame) -> DataFrame:
    """(chat, count, has_more_before, has_more_after, before_cursor, after_cursor) of each chat's page."""
    key = F.struct(*ORDER, F.concat_ws(":", F.col("db").cast("string"), F.col("local_id").cast("string")).alias("id"))
    own = paged.groupBy("chat").agg(F.count(F.lit(1)).alias("count"), F.min(key)["id"].alias("before_cursor"), F.max(key)["id"].alias("after_cursor"))
    return own.join(page_flags(messages, paged), "chat")


def with_total(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """(total, count) of a result: how many there are, and how many were picked."""
    return rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(picked.agg(F.count(F.lit(1)).alias("count")))  # one row each


def newest_first(paged: DataFrame) -> DataFrame:
    """A page with ``rn`` counted from its newest message."""
    n = F.count(F.lit(1)).over(Window.partitionBy("chat"))
    return paged.withColumn("rn", n - F.col("rn") + 1)


def limited(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` of ``rows`` in ``order``, with ``has_more``: whether there are others."""
    some = rows.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)  # at most limit + 1 rows
    return some.withColumns({"_nth": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy())}).filter(F.col("_nth") <= limit).withColumn("has_more", F.col("_n") > limit).drop("_nth", "_n")


def in_record_order(messages: DataFrame) -> DataFrame:
    """``messages`` with ``nth`` within its chat: by time, then sort_seq, the oldest shard (the greatest number) first, then local_id."""
    w = Window.partitionBy("chat").orderBy(F.coalesce("ts", F.lit(0)), F.coalesce("sort_seq", F.lit(0)), F.col("db").desc(), "local_id")
    return messages.withColumn("nth", F.row_number().over(w))


def profile(messages: DataFrame) -> DataFrame:
    """(chat, n, first_ts, last_ts, sent_by_me, sent_by_them)."""
    mine = F.count_if("is_self")
    return messages.groupBy("chat").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), mine.alias("sent_by_me"), (F.count(F.lit(1)) - mine).alias("sent_by_them"))


def by_id(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages with the wanted (chat, db, local_id)."""
    return messages.join(ids, ["chat", "db", "local_id"], "left_semi")


def first_of_day(messages: DataFrame) -> DataFrame:
    """(chat, day, ts, dbr, local_id): where each day of each chat begins, by partial aggregation."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return messages.groupBy("chat", day.alias("day")).agg(F.min(F.struct(*ORDER)).alias("_k")).select("chat", "day", "_k.*")


def with_day_headings(messages: DataFrame) -> DataFrame:
    """``messages`` with ``day`` and ``new_day``, true where the chat's day changes; time is the first key of the order, so that is a day's first message."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    begins = first_of_day(messages).withColumn("new_day", F.lit(True))
    return messages.withColumn("day", day).join(begins, ["chat", "day", *ORDER], "left").withColumn("new_day", F.coalesce("new_day", F.lit(False)))
