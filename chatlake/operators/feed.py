"""Feed posts: from XML to records, names, search and visibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chatlake.functions.scalars import first_filled, to_double, to_long, unsigned_id
from chatlake.operators.enrich import lookup

# Fixed values of the feed format.
POST_KINDS = {1: "image", 2: "text", 3: "link", 5: "video_link", 7: "image", 15: "video", 28: "channels", 34: "channels_live", 42: "music", 54: "image"}
MEDIA_KINDS = {2: "image", 6: "video"}
COMMENT = "username: STRING, nickname: STRING, create_time: STRING, b_deleted: STRING, comment_id: STRING, content: STRING, ref_username: STRING, imagelist: STRING, emojilist: STRING"
MEDIA = "id: STRING, type: STRING, url: STRUCT<_VALUE: STRING>, thumb: STRUCT<_VALUE: STRING>, size: STRUCT<_width: STRING, _height: STRING>, videoDuration: STRING, LivePhoto: STRING, title: STRING"
POST = f"""TimelineObject STRUCT<id: STRING, username: STRING, createTime: STRING, contentDesc: STRING, private: STRING, sourceNickName: STRING, appInfo: STRUCT<appName: STRING>,
  location: STRUCT<_poiName: STRING, _poiAddress: STRING, _city: STRING, _country: STRING, _latitude: STRING, _longitude: STRING>,
  ContentObject: STRUCT<type: STRING, title: STRING, description: STRING, contentUrl: STRING, mediaList: STRUCT<media: ARRAY<STRUCT<{MEDIA}>>>,
    finderFeed: STRUCT<nickname: STRING, desc: STRING>, finderLive: STRUCT<nickname: STRING, desc: STRING>, musicShareItem: STRUCT<mvSingerName: STRING>>>,
  LocalExtraInfo STRUCT<nickname: STRING, like_user_list: STRUCT<user_comment: ARRAY<STRUCT<{COMMENT}>>>, comment_user_list: STRUCT<user_comment: ARRAY<STRUCT<{COMMENT}>>>,
    with_user_list: STRUCT<user_comment: ARRAY<STRUCT<username: STRING>>>>"""


def clean_xml(content: Column) -> Column:
    """XML without declarations and control characters; null for a document type."""
    return F.when(~content.rlike(r"(?i)<!(DOCTYPE|ENTITY)"), F.regexp_replace(content, r"<\?xml[^>]*\?>|[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def _people(users: Column) -> Column:
    """Comments or likes that are not deleted."""
    return F.filter(F.coalesce(users, F.array().cast(f"array<struct<{COMMENT.lower()}>>")), lambda c: F.coalesce(to_long(c["b_deleted"]), F.lit(0)) == 0)


def parse_posts(raw: DataFrame) -> DataFrame:
    """Posts of rows (tid, user_name, content); what can't be parsed has a null ``kind`` and is counted by ``parse_stats``."""
    x = F.from_xml(F.regexp_replace(clean_xml(F.col("content")), r"(?s)^\s+", ""), POST)
    # A generator between the parser and what reads its fields: filters stop there, so that no text is parsed twice.
    rows = raw.withColumn("_x", F.explode(F.array(x))).withColumns({"_t": F.col("_x.TimelineObject"), "_e": F.col("_x.LocalExtraInfo")}).withColumn("_c", F.col("_t.ContentObject"))
    t, c, e = F.col("_t"), F.col("_c"), F.col("_e")
    rows = rows.withColumns(
        {
            "_type": F.coalesce(to_long(c["type"]), F.lit(0)).cast("int"), "_lat": to_double(t["location"]["_latitude"]), "_lon": to_double(t["location"]["_longitude"]),
            "_likes": _people(e["like_user_list"]["user_comment"]), "_comments": _people(e["comment_user_list"]["user_comment"]),
        }
    )
    nowhere = (F.col("_lat") == 0) & (F.col("_lon") == 0)
    place = F.struct(
        first_filled(t["location"]["_poiName"], t["location"]["_city"]).alias("name"), t["location"]["_poiAddress"].alias("address"), t["location"]["_city"].alias("city"),
        F.when(~nowhere, F.col("_lat")).alias("latitude"), F.when(~nowhere, F.col("_lon")).alias("longitude"),
    )
    media = F.transform(
        F.coalesce(c["mediaList"]["media"], F.array().cast("array<struct<id:string,type:string,url:struct<_VALUE:string>,thumb:struct<_VALUE:string>,size:struct<_width:string,_height:string>,videoDuration:string,LivePhoto:string,title:string>>")),
        lambda m: F.struct(
            m["id"].alias("id"), F.coalesce(lookup(MEDIA_KINDS, to_long(m["type"]).cast("int")), F.lit("cover")).alias("type"), m["url"]["_VALUE"].alias("url"), m["thumb"]["_VALUE"].alias("thumb"),
            F.coalesce(to_long(m["size"]["_width"]), F.lit(0)).alias("width"), F.coalesce(to_long(m["size"]["_height"]), F.lit(0)).alias("height"),
            F.nullif(to_double(m["videoDuration"]), F.lit(0.0)).alias("duration"), m["LivePhoto"].isNotNull().alias("live_photo"),
        ),
    )
    said = lambda k: F.concat_ws(" ", F.nullif(F.trim(k["content"]), F.lit("")), F.when(F.coalesce(k["imagelist"], F.lit("")) != "", "[图片]"), F.when(F.coalesce(k["emojilist"], F.lit("")) != "", "[表情]"))
    comments = F.transform(
        F.col("_comments"),
        lambda k, i: F.struct(F.coalesce(to_long(k["create_time"]), F.lit(0)).alias("ts"), i.alias("pos"), k["username"].alias("username"), k["nickname"].alias("nickname"), said(k).alias("text"), F.nullif(k["ref_username"], F.lit("")).alias("reply_to"), k["comment_id"].alias("id")),
    )
    likes = F.transform(F.col("_likes"), lambda k: F.struct(k["username"].alias("username"), k["nickname"].alias("nickname"), F.coalesce(to_long(k["create_time"]), F.lit(0)).alias("ts")))
    return rows.select(
        F.coalesce(F.nullif(t["id"], F.lit("")), unsigned_id(F.col("tid"))).alias("id"), first_filled(t["username"], F.col("user_name")).alias("username"), e["nickname"].alias("nickname"),
        F.coalesce(to_long(t["createTime"]), F.lit(0)).alias("ts"), F.col("_type").alias("type"), F.when(t.isNotNull(), F.coalesce(lookup(POST_KINDS, F.col("_type")), F.lit("other"))).alias("kind"),
        F.coalesce(F.trim(t["contentDesc"]), F.lit("")).alias("text"), F.coalesce(c["title"], F.lit("")).alias("title"),
        F.coalesce(first_filled(c["description"], c["finderFeed"]["desc"], c["finderLive"]["desc"]), F.lit("")).alias("description"), F.coalesce(c["contentUrl"], F.lit("")).alias("url"),
        F.coalesce(first_filled(t["sourceNickName"], c["finderFeed"]["nickname"], c["finderLive"]["nickname"], c["musicShareItem"]["mvSingerName"], t["appInfo"]["appName"]), F.lit("")).alias("source"),
        (F.coalesce(t["private"], F.lit("")) == "1").alias("private"), F.when(t["location"].isNotNull() & (first_filled(t["location"]["_poiName"], t["location"]["_city"], t["location"]["_poiAddress"]).isNotNull() | (F.col("_lat").isNotNull() & ~nowhere)), place).alias("location"),
        media.alias("media"), likes.alias("likes"), F.array_sort(comments).alias("comments"),
        F.filter(F.transform(F.coalesce(e["with_user_list"]["user_comment"], F.array().cast("array<struct<username:string>>")), lambda u: u["username"]), lambda u: F.coalesce(u, F.lit("")) != "").alias("with"),
    )


def parse_stats(posts: DataFrame) -> DataFrame:
    """(rows, parsed, failed)."""
    return posts.agg(F.count(F.lit(1)).alias("rows"), F.count("kind").alias("parsed"), F.count_if(F.col("kind").isNull()).alias("failed"))


def load_posts(raw: DataFrame, since: int | None = None, until: int | None = None) -> tuple[DataFrame, Observation]:
    """Parsed posts in [since, until), and what the same reading counts: rows, parsed, failed.

    The counts are there once an action on the posts has ended (``observation.get``); nothing is read twice. Take ``query_posts`` for order.
    """
    seen = Observation("posts")
    failed = F.count_if(F.col("kind").isNull())
    posts = parse_posts(raw).observe(seen, F.count(F.lit(1)).alias("rows"), F.count("kind").alias("parsed"), failed.alias("failed"))
    return query_posts(posts, since=since, until=until), seen


def search_text(row_prefix: str = "") -> Column:
    c = lambda n: F.col(row_prefix + n)
    return F.lower(F.concat_ws("\n", c("text"), c("title"), c("description"), c("source"), c("location.name"), F.array_join(F.transform(c("comments"), lambda k: k["text"]), "\n")))


def query_posts(posts: DataFrame, terms: Sequence[str] = (), author: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Parsed posts with every term, newest first; ``until`` is exclusive."""
    out = posts.filter(F.col("kind").isNotNull())
    if author is not None:
        out = out.filter(F.col("username") == author)
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    if until is not None:
        out = out.filter(F.col("ts") < until)
    if terms:
        # Behind a generator the searched text is made once, however many terms look at it.
        out = out.withColumn("_hay", F.explode(F.array(search_text())))
        for t in terms:
            out = out.filter(F.contains("_hay", F.lit(t.lower())))
        out = out.drop("_hay")
    return out if limit is None else out.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def counts(posts: DataFrame) -> DataFrame:
    """(id, images, videos, n_likes, n_comments)."""
    of = lambda kind: F.size(F.filter("media", lambda m: m["type"] == kind))
    return posts.select("id", of("image").alias("images"), of("video").alias("videos"), F.size("likes").alias("n_likes"), F.size("comments").alias("n_comments"))


def authors(posts: DataFrame) -> DataFrame:
    """(username, n, nickname): posts per author, and the newest nickname."""
    return posts.groupBy("username").agg(F.count(F.lit(1)).alias("n"), F.max_by("nickname", F.struct("ts", "id")).alias("nickname"))


def visible_posts(posts: DataFrame, hidden: DataFrame, own: str) -> DataFrame:
    """Posts whose author is not in ``hidden`` (username); deleted authors' comments stay; one's own are always visible."""
    gone = hidden.filter(F.col("username") != own)
    return posts.join(gone, "username", "left_anti")
