"""Exports of feed posts and bookmarks, and the compact view of query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import clock, escape_html, first_filled, joined, one_line

# How kinds are called in exports.
POST_LABELS = {"image": "图片", "text": "文字", "link": "链接", "video_link": "视频链接", "video": "视频", "channels": "视频号", "channels_live": "视频号直播", "music": "音乐", "other": "其他"}
BOOKMARK_LABELS = {
    "text": "文字", "image": "图片", "voice": "语音", "video": "视频", "link": "链接", "location": "位置", "music": "音乐", "file": "文件", "product": "商品", "tv": "视频",
    "chat_record": "聊天记录", "note": "笔记", "miniprogram": "小程序", "channels": "视频号", "other": "其他",
}


def _label(labels: dict, kind: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), kind), kind), F.lit("]"))


def summary(bookmark_columns: bool = True, width: int = 200) -> Column:
    """One line for a bookmark: title, else description, else its first item, else its place."""
    first = F.try_element_at("items", F.lit(1))
    return one_line(first_filled(F.col("title"), F.col("desc"), first["title"], first["desc"], F.col("location")), width)


def post_lines(posts: DataFrame, fmt: str) -> DataFrame:
    """(id, line) of each post as txt, md, html or json; comments follow on lines of their own."""
    head = joined(F.concat(F.lit("["), clock(F.col("ts")), F.lit("]")), first_filled(F.col("nickname"), F.col("username")), _label(POST_LABELS, F.col("kind")))
    body = first_filled(F.col("text"), F.col("title"), F.col("description"))
    said = F.transform("comments", lambda c: F.concat(F.lit("  "), first_filled(c["nickname"], c["username"]), F.lit(": "), c["text"]))
    liked = F.when(F.size("likes") > 0, F.concat(F.lit("  ♥ "), F.array_join(F.transform("likes", lambda k: first_filled(k["nickname"], k["username"])), ", ")))
    line = {
        "txt": F.concat_ws("\n", head, body, F.nullif(F.col("url"), F.lit("")), liked, F.nullif(F.array_join(said, "\n"), F.lit(""))),
        "md": F.concat_ws("\n\n", F.concat(F.lit("### "), head), F.replace(body, F.lit("<"), F.lit("&lt;")), F.nullif(F.array_join(F.transform(said, lambda s: F.concat(F.lit("- "), F.trim(s))), "\n"), F.lit(""))),
        "html": F.concat(F.lit("<article><h3>"), escape_html(head), F.lit("</h3><p>"), escape_html(F.coalesce(body, F.lit(""))), F.lit("</p>"), F.array_join(F.transform(said, lambda s: F.concat(F.lit("<p>"), escape_html(F.trim(s)), F.lit("</p>"))), ""), F.lit("</article>")),
        "json": F.to_json(F.struct(*posts.columns)),
    }
    return posts.select("id", line[fmt].alias("line"))


def bookmark_lines(bookmarks: DataFrame, fmt: str) -> DataFrame:
    """(id, line) of each bookmark as txt, md, html or json."""
    head = joined(F.concat(F.lit("["), clock(F.col("ts")), F.lit("]")), _label(BOOKMARK_LABELS, F.col("kind")), summary())
    tags = F.nullif(F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "), F.lit(""))
    url = F.when(F.col("url").rlike("(?i)^https?://"), F.col("url"))
    line = {
        "txt": F.concat_ws("\n", head, url, tags),
        "md": F.concat_ws("\n\n", F.concat(F.lit("### "), F.replace(head, F.lit("<"), F.lit("&lt;"))), F.concat(F.lit("<"), url, F.lit(">")), tags),
        "html": F.concat(F.lit("<article><h3>"), escape_html(head), F.lit("</h3>"), F.coalesce(F.concat(F.lit('<a href="'), escape_html(url), F.lit('">'), escape_html(url), F.lit("</a>")), F.lit("")), F.lit("</article>")),
        "json": F.to_json(F.struct(*bookmarks.columns)),
    }
    return bookmarks.select("id", line[fmt].alias("line"))


def compact(messages: DataFrame) -> DataFrame:
    """(chat, view): each chat's messages as day lines and ``HH:MM sender: text``, media with their id."""
    order = ("ts", "dbr", "local_id")
    day = F.substring(clock(F.col("ts")), 1, 10)
    new = F.coalesce(day != F.lag(day).over(Window.partitionBy("chat").orderBy(*order)), F.lit(True))
    mark = F.when(F.col("kind").isin("image", "voice", "video", "emoji"), F.concat(F.lit(" #"), F.concat_ws(":", F.col("db").cast("string"), F.col("local_id").cast("string")))).otherwise("")
    line = F.concat(F.when(F.col("_new"), F.concat(F.lit("-- "), day, F.lit("\n"))).otherwise(""), F.substring(clock(F.col("ts")), 12, 5), F.lit(" "), F.col("sender"), F.lit(": "), F.col("text"), mark)
    rows = messages.withColumn("_new", new).withColumn("_line", line)
    per = rows.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("x"))
    return per.select("chat", F.array_join(F.transform("x", lambda r: r["_line"]), "\n").alias("view"))


def with_names(posts: DataFrame, names: DataFrame) -> DataFrame:
    """``posts`` with ``author``: the contact's name (username, display) unless it is the username, else the nickname at the time."""
    n = names.withColumnsRenamed({"username": "_u", "display": "_d"})
    own = F.when(F.col("_d") != F.col("username"), F.col("_d"))
    return posts.join(n, posts["username"] == n["_u"], "left").withColumn("author", first_filled(own, F.col("nickname"), F.col("username"))).drop("_u", "_d")


def reply_names(posts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, pos, reply_to_name) of comments that answer someone: a name known inside the post, else the contact's, else the username."""
    inside = F.map_from_entries(F.array_distinct(F.transform(F.filter("comments", lambda c: F.coalesce(c["nickname"], F.lit("")) != ""), lambda c: F.struct(c["username"], F.element_at(F.transform(F.filter("comments", lambda d: d["username"] == c["username"]), lambda d: d["nickname"]), 1)))))
    each = posts.withColumn("_inside", inside).select("id", "_inside", F.posexplode("comments").alias("pos", "c")).filter(F.col("c.reply_to").isNotNull())
    n = names.withColumnsRenamed({"username": "_u", "display": "_d"})
    joined_ = each.join(n, F.col("c.reply_to") == F.col("_u"), "left")
    return joined_.select("id", "pos", first_filled(F.try_element_at("_inside", F.col("c.reply_to")), F.col("_d"), F.col("c.reply_to")).alias("reply_to_name"))
