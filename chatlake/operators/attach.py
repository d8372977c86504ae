"""Files found for messages, posts and bookmarks, attached to their records; and what became of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import decoders
from chatlake.functions.scalars import voice_stem
from chatlake.operators.media import format_of

KEY = ("chat", "db", "local_id")


def _nearest_month(ts: Column, month: Column) -> Column:
    """0 for the file's month being the message's, 1 and 2 for that of the day before and after, 3 for another."""
    day = lambda d: F.date_format(F.timestamp_seconds(ts + d * 86400), "yyyy-MM")
    return F.when(month == day(0), 0).when(month == day(-1), 1).when(month == day(1), 2).otherwise(3)


def locate_videos(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(chat, db, local_id, video, poster) of video messages (chat, db, local_id, ts, md5).

    ``files`` has md5, variant ('' or '_thumb'), month, path and the first bytes ``head``; the best-placed video without
    an MP4 header is one not wholly loaded and counts as missing.
    """
    both = messages.join(files, "md5")
    w = Window.partitionBy(*KEY, "variant").orderBy(_nearest_month(F.col("ts"), F.col("month")), "path")
    best = both.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1")
    whole = format_of(F.col("head")) == "mp4"
    per = best.groupBy(*KEY).agg(F.max(F.when((F.col("variant") == "") & whole, F.col("path"))).alias("video"), F.max(F.when(F.col("variant") == "_thumb", F.col("path"))).alias("poster"))
    return messages.select(*KEY).join(per, list(KEY), "left")


def with_resource_md5(messages: DataFrame, resources: DataFrame) -> DataFrame:
    """``messages`` (chat, local_id, ts, md5) with md5 filled from the resource table (chat, local_id, ts, md5); numbers repeat across shards, so the time must fit too."""
    r = resources.filter("md5 is not null").groupBy("chat", "local_id", "ts").agg(F.min("md5").alias("_md5"))
    return messages.join(r, ["chat", "local_id", "ts"], "left").withColumn("md5", F.coalesce("md5", "_md5")).drop("_md5")


def bookmark_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, pos, data, thumb) of bookmark items (id, pos, fullmd5, thumbmd5): files (md5 of the content, sub, path), data before mid before thumb."""
    order = F.array_position(F.array(F.lit("data"), F.lit("mid"), F.lit("thumb")), F.col("sub"))
    nth = F.row_number().over(Window.partitionBy("md5").orderBy(order, "path"))
    one = files.withColumn("_nth", nth).filter("_nth = 1").select(F.lower("md5").alias("_m"), F.col("path").alias("_p"))
    full = items.join(one, F.lower("fullmd5") == F.col("_m"), "left").withColumnRenamed("_p", "data").drop("_m")
    return full.join(one, F.lower("thumbmd5") == F.col("_m"), "left").select("id", "pos", "data", F.col("_p").alias("thumb"))


def existing_by_stem(wanted: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """(stem, path) of the wanted stems' files (stem, ext, path), the first extension in the list that is there."""
    place = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    there = files.filter(F.col("ext").isin(*extensions)).join(wanted.select("stem").distinct(), "stem", "left_semi")
    return there.withColumn("_nth", F.row_number().over(Window.partitionBy("stem").orderBy(place, "path"))).filter("_nth = 1").select("stem", "path")


def with_media(records: DataFrame, images: DataFrame | None = None, videos: DataFrame | None = None, audio: DataFrame | None = None, stickers: DataFrame | None = None, voices: DataFrame | None = None) -> DataFrame:
    """``records`` with image_path, video_path, poster_path, audio_path, voice and sticker_path from what the locators found, by (chat, db, local_id) and a sticker's md5.

    ``voices`` are blobs as ``media.locate_voices`` gives them; a record has its own as ``voice`` and the name of a file for it as ``voice_stem``.
    """
    out = records
    if images is not None:
        out = out.join(images.select(*KEY, F.col("path").alias("image_path")), list(KEY), "left")
    if videos is not None:
        out = out.join(videos.select(*KEY, F.col("video").alias("video_path"), F.col("poster").alias("poster_path")), list(KEY), "left")
    if audio is not None:
        out = out.join(audio.select(*KEY, F.col("path").alias("audio_path")), list(KEY), "left")
    if voices is not None:
        out = out.join(voices.select(*KEY, "voice"), list(KEY), "left").withColumn("voice_stem", F.when(F.col("voice").isNotNull(), voice_stem(F.col("server_id"), F.col("ts"), F.col("local_id"))))
    if stickers is not None:
        out = out.join(stickers.select("md5", F.col("path").alias("sticker_path")), "md5", "left")
    return out


def outcomes(found: DataFrame) -> DataFrame:
    """(kind, new, existing, missing, failed, thumb_only) over rows (kind, status, only_thumb)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return found.groupBy("kind").agg(n("new"), n("existing"), n("missing"), n("failed"), F.count_if("only_thumb").alias("thumb_only"))


def media_profile(content: Column, seconds: Column | None = None) -> Column:
    """A file's format and length as one struct; the length is read from the file unless it is given."""
    if seconds is None:
        return decoders.media_profile(content)
    return F.struct(format_of(content).alias("fmt"), seconds.alias("seconds"))
