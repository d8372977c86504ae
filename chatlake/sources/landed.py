"""Landing of other SQLite tables: one table of every file of a folder, tolerant of what a file lacks.

    spark.dataSource.register(LandedTable)
    landed(spark, "/landing/account", "message_*.db", **NAMES)

One input partition is one file. A file without the table gives no rows, and a column that it lacks is null, so
accounts of older versions read alike. Workers open the files, so the folder must be on every machine's path.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructType

BATCH = 5000
# Tables of the archive and the columns read of them; ``rowid`` is SQLite's own.
NAMES = {"table": "Name2Id", "columns": "rowid long, user_name string"}
CONTACTS = {"table": "contact", "columns": "username string, local_type int, verify_flag int, remark string, nick_name string, alias string"}
STRANGERS = CONTACTS | {"table": "stranger"}
ROOMS = {"table": "chat_room", "columns": "username string, owner string, ext_buffer binary"}
POSTS = {"table": "SnsTimeLine", "columns": "tid long, user_name string, content binary"}
BOOKMARKS = {"table": "fav_db_item", "columns": "local_id long, server_id long, type int, update_time long, content binary"}
BOOKMARK_TAGS = {"table": "fav_tag_db_item", "columns": "local_id long, name string"}
BOOKMARK_TAG_BINDS = {"table": "fav_bind_tag_db_item", "columns": "tag_local_id long, fav_local_id long"}
VOICES = {"table": "VoiceInfo", "columns": "chat_name_id long, create_time long, local_id long, svr_id long, voice_data binary, data_index string"}
RESOURCES = {"table": "MessageResourceInfo", "columns": "chat_id long, message_local_id long, message_local_type long, message_create_time long, packed_info binary"}
RESOURCE_CHATS = {"table": "ChatName2Id", "columns": "rowid long, user_name string"}
STICKERS = {"table": "kNonStoreEmoticonTable", "columns": "md5 string, cdn_url string, encrypt_url string, extern_url string, extern_md5 string, thumb_url string"}


@dataclass
class FilePartition(InputPartition):
    path: str
    number: int | None


class LandedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_table"

    def schema(self) -> str:
        return f"db int, {self.options['columns']}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.files, self.table = options["path"], options["files"], options["table"]
        self.fields = [(f.name, f.dataType) for f in schema.fields[1:]]

    def partitions(self) -> list[FilePartition]:
        found = sorted(glob.glob(os.path.join(self.folder, self.files)))
        return [FilePartition(p, int(n[1]) if (n := re.search(r"_(\d+)\.db$", p)) else None) for p in found]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        with sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True) as db:
            there = {row[1].lower(): row[1] for row in db.execute(f'PRAGMA table_info("{self.table}")')}
            if not there:
                return
            wanted = ["rowid" if n == "rowid" else f'"{there[n.lower()]}"' if n.lower() in there else "NULL" for n, _ in self.fields]
            rows = db.execute(f'SELECT {", ".join(wanted)} FROM "{self.table}"')
            while batch := rows.fetchmany(BATCH):
                for row in batch:
                    yield (partition.number, *(_typed(v, kind) for v, (_, kind) in zip(row, self.fields, strict=True)))


def _typed(value, kind):
    """SQLite's value as the column's type: texts and blobs turn into each other, other mismatches are null."""
    if value is None:
        return None
    if isinstance(kind, BinaryType):
        return value.encode() if isinstance(value, str) else value if isinstance(value, bytes) else str(value).encode()
    if isinstance(kind, StringType):
        return value.decode(errors="replace") if isinstance(value, bytes) else str(value)
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def landed(spark: SparkSession, folder: str, files: str, table: str, columns: str) -> DataFrame:
    """(db, ...) of ``table`` in all ``files`` of ``folder``; db is the number in a file's name, null without one."""
    return spark.read.format("landed_table").option("files", files).option("table", table).option("columns", columns).load(folder)


def file_table(binary: DataFrame, stem: str, key: str = "key") -> DataFrame:
    """(path, mtime, size, key, ext) of a ``binaryFile`` frame's files whose stem matches ``stem``; half-written ``.tmp`` files are left out."""
    from pyspark.sql import functions as F

    name = F.element_at(F.split("path", "/"), -1)
    found = binary.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), F.regexp_extract(name, rf"^({stem})(?:\.(\w+))?$", 1).alias(key), F.regexp_extract(name, r"\.(\w+)$", 1).alias("ext"))
    return found.filter((F.col(key) != "") & (F.col("ext") != "tmp"))
