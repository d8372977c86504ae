"""What questions return: projections with counts in place of lists, capped parts, names joined in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import cap_text, filled, first_filled
from chatlake.operators import bookmarks as B
from chatlake.operators.render_records import BOOKMARK_LABELS

MAX_COMMENTS, MAX_ITEMS, MAX_MEMBERS, MAX_ROOMS = 100, 200, 500, 100


def capped(items: Column, limit: int) -> tuple[Column, Column]:
    """The first ``limit`` of an array, and how many more there are, null for none."""
    return F.slice(items, 1, limit), F.nullif(F.greatest(F.size(items) - limit, F.lit(0)), F.lit(0))


def message_view() -> list[Column]:
    """Columns of a message with the default kind and empty details left out (null)."""
    return [F.concat_ws(":", F.col("db").cast("string"), F.col("local_id").cast("string")).alias("id"), "ts", "sender", F.when(F.col("kind") != "text", F.col("kind")).alias("kind"), cap_text(F.col("text")).alias("text")]


def hits_with_names(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Search hits with the chat's name (chat, name); the chat stands for a missing one."""
    return hits.join(names.select("chat", "name"), "chat", "left").withColumn("chat_name", F.coalesce("name", F.col("chat").cast("string"))).drop("name")


def post_view(posts: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Posts with media as counts, and at most MAX_COMMENTS comments; ``cached`` has (post_id, media_id) of the media found locally."""
    some, more = capped(F.col("comments"), MAX_COMMENTS)
    of = lambda kind: F.size(F.filter("media", lambda m: m["type"] == kind))
    view = posts.select(
        "id", "ts", "username", F.when(F.col("kind") != "image", F.col("kind")).alias("kind"), cap_text(filled(F.col("text"))).alias("text"), filled(F.col("title")).alias("title"), filled(F.col("url")).alias("url"),
        F.when(F.col("private"), True).alias("private"), first_filled(F.col("location.name"), F.col("location.address")).alias("location"), of("image").alias("images"), of("video").alias("videos"),
        F.size("likes").alias("n_likes"), some.alias("comments"), more.alias("comments_truncated"),
    )
    if cached is None:
        return view
    n = cached.groupBy(F.col("post_id").alias("id")).agg(F.count_distinct("media_id").alias("cached_locally"))
    return view.join(n, "id", "left").withColumn("cached_locally", F.coalesce("cached_locally", F.lit(0)))


def with_sources(bookmarks: DataFrame, names: DataFrame, own: str) -> DataFrame:
    """``bookmarks`` with from_name, sender_name, chat_name and is_self: who wrote it in a group, else the peer; the chat's name for groups."""
    group = F.endswith("from", F.lit("@chatroom"))
    who = F.coalesce(filled(F.col("sender")), F.when(~group, filled(F.col("from"))))
    one = names.select("username", "display").dropDuplicates(["username"])
    rows = bookmarks.withColumn("_who", who)
    rows = rows.join(one.withColumnsRenamed({"username": "_f", "display": "_fn"}), F.col("from") == F.col("_f"), "left").join(one.withColumnsRenamed({"username": "_w", "display": "_wn"}), F.col("_who") == F.col("_w"), "left")
    chat = F.when(filled(F.col("from")).isNotNull(), first_filled(F.col("_fn"), F.col("from")))
    rows = rows.withColumns({"from_name": chat, "sender_name": F.when(F.col("_who") == own, "我").otherwise(first_filled(F.col("_wn"), F.col("_who"))), "chat_name": F.when(group, chat), "is_self": F.coalesce(F.col("_who") == own, F.lit(False))})
    return rows.drop("_who", "_f", "_fn", "_w", "_wn")


def source_line() -> Column:
    """The sender, and the group it was said in unless that has the same name."""
    return F.concat_ws(" · ", filled(F.col("sender_name")), F.when(~F.col("chat_name").eqNullSafe(F.col("sender_name")), F.concat(F.lit("群: "), F.col("chat_name"))))


def item_lines() -> Column:
    """The items of a forwarded record as ``sender: text``, a kind's label for one without text."""
    labels = F.create_map(*[F.lit(x) for kv in BOOKMARK_LABELS.items() for x in kv])
    text = lambda d: first_filled(d["desc"], d["title"], F.concat(F.lit("["), F.coalesce(F.try_element_at(labels, d["kind"]), d["kind"]), F.lit("]")))
    return F.transform("items", lambda d: F.concat(F.when(filled(d["sender_name"]).isNotNull(), F.concat(d["sender_name"], F.lit(": "))).otherwise(""), text(d)))


def bookmark_detail(bookmarks: DataFrame, ids: DataFrame, hidden: DataFrame, own: str) -> DataFrame:
    """The wanted (id) bookmarks that may be seen, whole but for items beyond MAX_ITEMS; a hidden one is as one that doesn't exist."""
    seen = B.visible_bookmarks(bookmarks.join(ids.select("id").distinct(), "id", "left_semi"), hidden, own)
    some, more = capped(F.col("items"), MAX_ITEMS)
    return seen.select("id", "ts", "kind", filled(F.col("title")).alias("title"), filled(cap_text(F.col("desc"))).alias("text"), filled(F.col("url")).alias("url"), "tags", "location", some.alias("items"), more.alias("items_truncated"))


def author_names(posts: DataFrame, contacts: DataFrame) -> DataFrame:
    """(username, name): every name a post's author is known by, of posts (username, nickname) and contacts (username, display, remark, nick_name, alias)."""
    authors = posts.select("username", "nickname").distinct()  # twice the same shuffle, so posts are read once
    own = authors.select("username", F.explode(F.array("username", "nickname")).alias("name"))
    there = contacts.join(authors, "username", "left_semi")
    known = there.select("username", F.explode(F.array("display", "remark", "nick_name", "alias")).alias("name"))
    return own.unionByName(known).filter(F.coalesce("name", F.lit("")) != "").distinct()


def contact_profiles(people: DataFrame, chat_stats: DataFrame, members: DataFrame) -> DataFrame:
    """(username, display, is_group, msg_count, first_ts, last_ts, member_count, shared_group_count) of people (username, display)."""
    counts = members.groupBy(F.col("room").alias("username")).agg(F.count_distinct("member").alias("member_count"))
    shared = members.groupBy(F.col("member").alias("username")).agg(F.count_distinct("room").alias("shared_group_count"))
    out = people.join(chat_stats.withColumnRenamed("chat", "username"), "username", "left").join(counts, "username", "left").join(shared, "username", "left")
    return out.select("username", "display", F.endswith("username", F.lit("@chatroom")).alias("is_group"), F.coalesce("n", F.lit(0)).alias("msg_count"), "first_ts", "last_ts", "member_count", F.coalesce("shared_group_count", F.lit(0)).alias("shared_group_count"))


def grouped_hits(hits: DataFrame) -> DataFrame:
    """``hits`` with ``chat_rank``, chats by their newest hit, and ``nth`` within the chat, newest first; rows stay rows."""
    order = [F.col("ts").desc(), F.col("dbr").desc(), F.col("local_id").desc()]
    newest = hits.groupBy("chat").agg(F.max(F.struct("ts", "dbr", "local_id")).alias("_newest"))
    ranks = newest.withColumn("chat_rank", F.row_number().over(Window.orderBy(F.col("_newest").desc(), "chat"))).drop("_newest")  # one row a chat with hits
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("chat").orderBy(*order))).join(ranks, "chat")
