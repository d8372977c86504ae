"""From an account's files to what the operators take: voices, image hashes, stickers and bookmarked files.

The tables are scanned as they are (``landed``); here their own ids become the chats, stores and hashes by which ``media`` and ``attach`` join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.media import md5_in
from chatlake.sources import landed as tables

#: Where copies of a sticker lie, the first to be taken first.
STICKER_PLACES = ("own", "recent", "older")
#: Where a bookmark's files lie: the file itself, a middle size, a thumbnail.
BOOKMARK_FOLDERS = ("data", "mid", "thumb")
IMAGE_TYPE = 3


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(tables.LandedTable)


def _chats(spark: SparkSession, folder: str, files: str, table: dict) -> DataFrame:
    """(db, id, chat) of each file's own dictionary of chats."""
    return tables.landed(spark, folder, files, **table).select("db", F.col("rowid").alias("id"), F.col("user_name").alias("chat"))


def voices(spark: SparkSession, folder: str) -> DataFrame:
    """(store, chat, server_id, ts, local_id, data_index, data) of every voice chunk, as ``media.locate_voices`` takes them.

    A file's chat ids are its own; the store is the number in its name. Chunks without bytes are no voice.
    """
    _register(spark)
    rows = tables.landed(spark, folder, "media_*.db", **tables.VOICES).filter(F.octet_length("voice_data") > 0)
    names = _chats(spark, folder, "media_*.db", tables.NAMES)
    same = rows["db"].eqNullSafe(names["db"]) & (rows["chat_name_id"] == names["id"])
    return rows.join(names, same).select(
        rows["db"].alias("store"), "chat", F.coalesce("svr_id", F.lit(0)).alias("server_id"), F.col("create_time").alias("ts"), "local_id", "data_index", F.col("voice_data").alias("data")
    )


def image_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(chat, local_id, ts, md5) of the resource table's images, as ``attach.with_resource_md5`` takes them."""
    _register(spark)
    rows = tables.landed(spark, folder, "message_resource.db", **tables.RESOURCES).filter(F.col("message_local_type") == IMAGE_TYPE)
    names = _chats(spark, folder, "message_resource.db", tables.RESOURCE_CHATS)
    found = rows.join(names.select("id", "chat"), rows["chat_id"] == F.col("id"))
    return found.select("chat", F.col("message_local_id").alias("local_id"), F.col("message_create_time").alias("ts"), md5_in(F.col("packed_info")).alias("md5")).filter("md5 is not null")


def stickers(spark: SparkSession, folder: str) -> DataFrame:
    """(md5, cdn_url, encrypt_url, extern_url, extern_md5, thumb_url) with hashes in small letters, one row each, empty instead of null."""
    _register(spark)
    rows = tables.landed(spark, folder, "emoticon.db", **tables.STICKERS).filter(F.coalesce("md5", F.lit("")) != "")
    others = ("cdn_url", "encrypt_url", "extern_url", "extern_md5", "thumb_url")
    last = rows.groupBy(F.lower("md5").alias("md5")).agg(F.max(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in others])).alias("v"))
    return last.select("md5", "v.*")


def sticker_copies(files: DataFrame) -> DataFrame:
    """(md5, path) of the best copy of each sticker file (md5, place, mtime, path): by place, then the newest."""
    place = F.array_position(F.array(*map(F.lit, STICKER_PLACES)), F.col("place"))
    best = F.min_by("path", F.struct(place, -F.col("mtime"), F.col("path")))
    return files.filter(F.col("place").isin(*STICKER_PLACES)).groupBy(F.lower("md5").alias("md5")).agg(best.alias("path"))


def files_by_digest(binary: DataFrame) -> DataFrame:
    """(md5, sub, path) of a ``binaryFile`` frame of bookmark folders: the digest of each file's bytes, as ``attach.bookmark_files`` takes them.

    Files under one of BOOKMARK_FOLDERS count; digests are made where the files are read.
    """
    sub = F.regexp_extract("path", rf"/({'|'.join(BOOKMARK_FOLDERS)})/[^/]+/[^/]+$", 1)
    return binary.select(F.md5("content").alias("md5"), sub.alias("sub"), "path").filter("sub <> ''")
