"""Rooms, their members, and what people share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("room").agg(F.count_distinct("member").alias("member_count"))


def first_members(members: DataFrame, n: int) -> DataFrame:
    """(room, nth, member): the first ``n`` members by position."""
    w = Window.partitionBy("room").orderBy("pos", "member")
    return members.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("room", "nth", "member")


def unnamed_room_names(members: DataFrame, own: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """(room, name): a room's first three members but oneself, and with more of them how many there are with oneself.

    ``own`` tells oneself by ``member``; ``names`` (member, display) gives names, the member stands for a missing one.
    Rooms without others have no name. A rank per room keeps three rows, so no room's members are gathered.
    """
    others = members.select("room", "pos", "member")
    others = others if own is None else others.filter(~own)
    w = Window.partitionBy("room").orderBy("pos", "member")
    first = others.withColumn("nth", F.row_number().over(w)).filter("nth <= 3")
    shown = F.col("member").cast("string")
    if names is not None:
        first, shown = first.join(names.select("member", "display"), "member", "left"), F.coalesce("display", F.col("member").cast("string"))
    of = lambda k: F.max(F.when(F.col("nth") == k, shown))
    three = first.groupBy("room").agg(F.concat_ws("、", of(1), of(2), of(3)).alias("three"))
    n = others.groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    tail = F.when(F.col("n") > 3, F.concat(F.lit("等"), (F.col("n") + 1).cast("string"), F.lit("人"))).otherwise("")
    return three.join(n, "room").select("room", F.concat("three", tail).alias("name"))


def members_with_names(members: DataFrame, names: DataFrame, n: int = 500) -> DataFrame:
    """(room, nth, member, name): the first ``n`` members with the names (member, display) they are known by."""
    return first_members(members, n).join(names.select("member", "display"), "member", "left").select("room", "nth", "member", F.coalesce("display", F.col("member").cast("string")).alias("name"))


def nicknames(members: DataFrame) -> DataFrame:
    """(room, member, nick) of the members that have a nickname in their room."""
    return members.filter(F.trim(F.coalesce("nick", F.lit(""))) != "").select("room", "member", "nick")


def shared_rooms(members: DataFrame, activity: DataFrame, top: int = 100) -> DataFrame:
    """(member, room, member_count, last_ts, nth): each person's ``top`` rooms by last activity, unknown last."""
    stats = member_counts(members).join(activity, "room", "left")
    w = Window.partitionBy("member").orderBy(F.col("last_ts").desc_nulls_last(), "room")
    rooms = members.select("member", "room").distinct().join(stats, "room")
    return rooms.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).select("member", "room", "member_count", "last_ts", "nth")
