"""Where the media of messages, posts and bookmarks lie; nothing is copied or decoded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import cache_key, unescape_entities

#: What a message is known by; numbers repeat across shards.
KEY = ("chat", "db", "local_id")
#: Image variants, best first: high resolution, plain, thumbnail.
VARIANTS = ["_h", "", "_t"]
#: Variants of cached feed media. Fixed values.
FEED_VARIANTS = {"thumb": 1, "full": 2, "video": 3, "square": 6}


def md5_in(binary: Column) -> Column:
    """The first 32 lower-case hexadecimal digits that stand alone in some bytes."""
    return F.nullif(F.regexp_extract(F.decode(binary, "ISO-8859-1"), r"(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])", 1), F.lit(""))


def locate_images(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(chat, db, local_id, path) of the best file of each image message.

    ``messages`` has chat, db, local_id, ts, md5, without db where there is one shard; ``files`` chat, md5, month, variant, path. Files of the
    message's month or of a day next to it come first, by variant, then those of any month.
    """
    months = F.array(*[F.date_format(F.timestamp_seconds(F.col("ts") + d * 86400), "yyyy-MM") for d in (-1, 0, 1)])
    both = messages.withColumn("_months", months).join(files, ["chat", "md5"])
    order = [F.when(F.array_contains("_months", F.col("month")), 0).otherwise(1), F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")), F.col("month").desc(), F.col("path")]
    key = [k for k in KEY if k in messages.columns]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return both.withColumn("_nth", nth).filter("_nth = 1").select(*key, "path")


def newest_copies(files: DataFrame) -> DataFrame:
    """One file per key, the newest, and of equally new ones the first path."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("mtime").desc(), "path"))
    return files.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def locate_feed_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """(post_id, media_id, full, thumb, video): cached files of rows (post_id, media_id) by the hash of both and a variant."""
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("no")) for n, v in FEED_VARIANTS.items()]))
    wanted = media.select("post_id", "media_id", variants.alias("v")).withColumn("key", cache_key(F.col("post_id"), F.col("media_id"), F.col("v.no").cast("string")))
    found = wanted.join(newest_copies(files), "key", "left")
    of = lambda n: F.max(F.when(F.col("v.name") == n, F.col("path")))
    return found.groupBy("post_id", "media_id").agg(of("full").alias("full"), F.coalesce(of("thumb"), of("square")).alias("thumb"), of("video").alias("video"))


def locate_voices(messages: DataFrame, blobs: DataFrame) -> DataFrame:
    """(chat, db, local_id, voice): the blob of each voice message by (chat, server_id), else by (chat, ts, local_id).

    Of several stores the one with the least number wins; its chunks are joined by index,
    an index that is no number counting as 0.
    """
    index = F.coalesce(F.col("data_index").try_cast("long"), F.lit(0))
    whole = blobs.groupBy("store", "chat", "server_id", "ts", "local_id").agg(F.sort_array(F.collect_list(F.struct(index.alias("i"), F.col("data")))).alias("parts"))
    whole = whole.withColumn("voice", F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["data"]))).drop("parts")
    by_server = whole.filter("server_id <> 0").groupBy("chat", "server_id").agg(F.min_by("voice", "store").alias("by_server"))
    by_time = whole.groupBy("chat", "ts", "local_id").agg(F.min_by("voice", "store").alias("by_time"))
    both = messages.join(by_server, ["chat", "server_id"], "left").join(by_time, ["chat", "ts", "local_id"], "left")
    return both.select(*[k for k in KEY if k in messages.columns], F.coalesce("by_server", "by_time").alias("voice"))


def sticker_info(content: Column) -> Column:
    """The attributes of a sticker message as a map, entities undone; a name may have hyphens and colons."""
    pair = F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"')
    names, values = F.regexp_extract_all(content, pair, 1), F.regexp_extract_all(content, pair, 2)
    plain = F.transform(values, unescape_entities)
    first = F.transform(F.array_distinct(names), lambda n: F.element_at(plain, F.array_position(names, n).cast("int")))
    return F.map_from_arrays(F.array_distinct(names), first)


def sticker_md5(info: Column) -> Column:
    """The md5 among a sticker's attributes, if it is one."""
    md5 = F.lower(F.trim(F.try_element_at(info, F.lit("md5"))))
    return F.when(md5.rlike("^[0-9a-f]{32}$"), md5)


def merge_urls(info: DataFrame, table: DataFrame) -> DataFrame:
    """``info`` (md5, cdn_url, thumb_url) with empty addresses filled from ``table``."""
    t = table.select("md5", F.col("cdn_url").alias("_cdn"), F.col("thumb_url").alias("_thumb"))
    fill = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    return info.join(t, "md5", "left").select("md5", fill("cdn_url", "_cdn").alias("cdn_url"), fill("thumb_url", "_thumb").alias("thumb_url"))


def sticker_status(stickers: DataFrame, cached: DataFrame, local: DataFrame, attempts: DataFrame, now: int, download: bool = True) -> DataFrame:
    """(md5, status): cached, local, unavailable, failed (in the last 7 days) or to fetch."""
    s = stickers.join(cached.select("md5").distinct().withColumn("_c", F.lit(True)), "md5", "left").join(local.select("md5").distinct().withColumn("_l", F.lit(True)), "md5", "left")
    failed = attempts.filter(F.col("failed_at") > now - 7 * 86400).select("md5").distinct().withColumn("_f", F.lit(True))
    s = s.join(failed, "md5", "left")
    status = F.when(F.col("_c"), "cached").when(F.col("_l"), "local").when(F.lit(not download) | F.coalesce("cdn_url", F.lit("")).eqNullSafe(""), "unavailable").when(F.col("_f"), "failed").otherwise("fetch")
    return s.select("md5", status.alias("status"))


def distinct_stickers(messages: DataFrame, order: Sequence[str] = ("ts", "dbr", "local_id")) -> DataFrame:
    """(md5, cdn_url, thumb_url, n) of each sticker: what its last message in ``order`` says, and how many messages it has; what has no md5 is left out."""
    last = F.max_by(F.struct("cdn_url", "thumb_url"), F.struct(*order))
    return messages.filter("md5 is not null").groupBy("md5").agg(last.alias("_last"), F.count(F.lit(1)).alias("n")).select("md5", "_last.*", "n")


def coverage(messages: DataFrame) -> DataFrame:
    """(messages, stickers, with_url, with_thumb) of sticker messages (md5, cdn_url, thumb_url)."""
    per = messages.groupBy("md5").agg(F.max(F.coalesce("cdn_url", F.lit("")) != "").alias("u"), F.max(F.coalesce("thumb_url", F.lit("")) != "").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("stickers"), F.count_if("u").alias("with_url"), F.count_if("t").alias("with_thumb"))


def format_of(content: Column) -> Column:
    """A file's kind by its first bytes."""
    head = lambda h: F.startswith(content, F.to_binary(F.lit(h), F.lit("hex")))
    return (
        F.when(head("FFD8FF"), "jpg").when(head("89504E47"), "png").when(head("47494638"), "gif").when(head("424D"), "bmp")
        .when(head("52494646") & (F.substring(content, 9, 4) == F.to_binary(F.lit("57454250"), F.lit("hex"))), "webp")
        .when(F.substring(content, 5, 4) == F.to_binary(F.lit("66747970"), F.lit("hex")), "mp4").otherwise("bin")
    )
