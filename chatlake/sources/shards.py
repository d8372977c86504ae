"""Landing: plain SQLite message shards as a Spark data source, batch and streaming, and the landing manifest.

    read_shards(spark, "/landing/account").filter("tbl = 'Msg_...' and base_type = 47 and create_time >= 1700000000")
    stream_shards(spark, "/landing/account")

One input partition is one message table of one shard, so shards of any number are read side by side, and rows cross to
Spark as Arrow batches. Filters on the shard and the table drop partitions, so their tables are never opened; filters on
numbers become predicates of SQLite. A stream's offset says for each table how far it was read and what was there, so a poll
opens only the files that changed and reads only the rows above the number read before. Workers open the files, so
the folder must be on every machine's path.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.streaming import DataStreamWriter

SCHEMA = "db int, tbl string, local_id long, server_id long, local_type long, sort_seq long, real_sender_id long, create_time long, content binary, ct int, packed_info binary, dbr int, base_type long"
#: Columns of a message table in the order of SCHEMA, behind db and tbl; one with a star ends so. Fixed values.
COLUMNS = ("local_id", "server_id", "local_type", "sort_seq", "real_sender_id", "create_time", "message_content", "*_CT_message_content", "packed_info_data")
NUMBERS = COLUMNS[:6]
ARROW = pa.schema(
    [("db", pa.int32()), ("tbl", pa.string()), *((c, pa.int64()) for c in NUMBERS), ("content", pa.binary()), ("ct", pa.int32()), ("packed_info", pa.binary()), ("dbr", pa.int32()), ("base_type", pa.int64())]
)
#: The kind of a message is in the low half of its type; what kind of attachment, in the high half.
LOW_HALF = (1 << 32) - 1
BATCH = 5000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARISONS = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class TablePartition(InputPartition):
    """Rows of a table with ``after`` < local_id <= ``upto``; null is no bound."""

    path: str
    number: int
    table: str
    after: int | None = None
    upto: int | None = None
    rebuilt: bool = False


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def shard_number(path: str) -> int | None:
    found = re.fullmatch(r"message_(\d+)\.db", os.path.basename(path))
    return int(found[1]) if found else None


def shard_files(folder: str) -> list[tuple[int, str]]:
    """(number, path) of the shards, by number."""
    found = ((shard_number(p), p) for p in glob.glob(os.path.join(folder, "message_*.db")))
    return sorted((n, p) for n, p in found if n is not None)


def _tables(db: sqlite3.Connection) -> list[str]:
    return [t for (t,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name GLOB 'Msg_*' ORDER BY name")]


def _number(column: str) -> str:
    """A number column as the row gives it: what is no whole number is null. ``local_id`` is the table's key."""
    if column == "base_type":
        return f"(CASE WHEN typeof(local_type) = 'integer' THEN local_type & {LOW_HALF} END)"
    return f'"{column}"' if column == "local_id" else f"(CASE WHEN typeof(\"{column}\") = 'integer' THEN \"{column}\" END)"


class MessageShards(DataSource):
    """Options: ``path``; ``push``, which asks for pushed filters (see ``read_shards``)."""

    @classmethod
    def name(cls) -> str:
        return "message_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = str(self.options.get("push", "false")).lower() == "true"
        return (_PushingReader if pushing else _Reader)(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


class MessageShardChanges(MessageShards):
    """The stream with a column ``rebuilt``: true for rows of a table that is read anew as its older rows have changed."""

    @classmethod
    def name(cls) -> str:
        return "message_shard_changes"

    def schema(self) -> str:
        return SCHEMA + ", rebuilt boolean"


def _batches(partition: TablePartition, where: list[str], values: list, rebuilt: bool | None = None) -> Iterator[pa.RecordBatch]:
    with _open(partition.path) as db:
        there = [row[1] for row in db.execute(f'PRAGMA table_info("{partition.table}")')]
        found = [next((t for t in there if t == c or (c[0] == "*" and t.endswith(c[1:]))), None) for c in COLUMNS]
        wanted = [(_number(c) if c in NUMBERS else f'"{c}"') if c else "NULL" for c in found]
        bounds = [(f"local_id > {partition.after}", partition.after), (f"local_id <= {partition.upto}", partition.upto)]
        tests = [*where, *(t for t, v in bounds if v is not None)]
        rows = db.execute(f'SELECT {", ".join(wanted)}, {_number("base_type")} FROM "{partition.table}"' + (f" WHERE {' AND '.join(tests)}" if tests else ""), values)
        while batch := rows.fetchmany(BATCH):
            *numbers, content, ct, packed, base = zip(*batch, strict=True)
            n = len(batch)
            blob = lambda values: [v.encode() if isinstance(v, str) else v if isinstance(v, bytes) or v is None else str(v).encode() for v in values]
            whole = lambda values: [v if isinstance(v, int) else None for v in values]
            columns = [[partition.number] * n, [partition.table] * n, *numbers, blob(content), whole(ct), blob(packed), [-partition.number] * n, base]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)]
            out = pa.RecordBatch.from_arrays(arrays, schema=ARROW)
            yield out if rebuilt is None else out.append_column("rebuilt", pa.array([rebuilt] * n))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.where: list[str] = []
        self.values: list = []
        self.needed: set[str] = set()
        self.shards: set[int] | None = None
        self.only: set[str] | None = None

    def partitions(self) -> list[TablePartition]:
        out = []
        for number, path in shard_files(self.path):
            if self.shards is not None and number not in self.shards:
                continue
            with _open(path) as db:
                out += [TablePartition(path, number, t) for t in _tables(db) if self.only is None or t in self.only]
        return out

    def read(self, partition: TablePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # null: no table at all
            yield from _batches(partition, self.where, self.values)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        """Whether SQLite, or the choice of partitions, does all that the filter asks."""
        if len(getattr(f, "attribute", ())) != 1:
            return False
        column = f.attribute[0]
        if column in ("db", "tbl") and isinstance(f, EqualTo | In):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if column == "db":
                self.shards = wanted if self.shards is None else self.shards & wanted
            else:
                self.only = wanted if self.only is None else self.only & wanted
            return True
        if column in ("db", "tbl") and isinstance(f, IsNotNull):
            return True  # they never are
        if column not in (*NUMBERS, "base_type"):
            return False
        if isinstance(f, IsNull | IsNotNull):
            self.where.append(f"{_number(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
        elif isinstance(f, In):
            values = [v for v in f.value if v is not None]
            self.where.append(f"{_number(column)} IN ({', '.join('?' * len(values))})")
            self.values += values
        elif type(f) in COMPARISONS:
            self.where.append(f"{_number(column)} {COMPARISONS[type(f)]} ?")
            self.values.append(f.value)
        else:
            return False
        return True


def _extent(db: sqlite3.Connection, table: str, upto: int | None = None) -> dict:
    """What a table holds up to a number: the greatest one, how many rows, the sum of their types."""
    top, n, types = db.execute(f'SELECT coalesce(max(local_id), 0), count(*), coalesce(sum({_number("local_type")}), 0) FROM "{table}"' + ("" if upto is None else f" WHERE local_id <= {upto}")).fetchone()
    return {"top": top, "n": n, "types": types}


class _StreamReader(DataSourceStreamReader):
    """Offsets: ``{"files": {name: {"size", "mtime", "tables": {table: {"top", "n", "types"}}}}}``."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for _, path in shard_files(self.path):
            name, stat = os.path.basename(path), os.stat(path)
            state = self.known.get(name)
            if state is None or (state["size"], state["mtime"]) != (stat.st_size, stat.st_mtime_ns):
                with _open(path) as db:
                    state = {"size": stat.st_size, "mtime": stat.st_mtime_ns, "tables": {t: _extent(db, t) for t in _tables(db)}}
            files[name] = state
        self.known = files
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[TablePartition]:
        out = []
        for name, state in sorted(end["files"].items()):
            path, before = os.path.join(self.path, name), start["files"].get(name, {"tables": {}})
            if (before.get("size"), before.get("mtime")) == (state["size"], state["mtime"]):
                continue
            with _open(path) as db:
                for table, now in sorted(state["tables"].items()):
                    old = before["tables"].get(table)
                    if old is None:
                        out.append(TablePartition(path, shard_number(path), table, None, now["top"]))
                    elif _extent(db, table, old["top"]) != old:  # an older row was changed or is gone
                        out.append(TablePartition(path, shard_number(path), table, None, now["top"], True))
                    elif now["top"] > old["top"]:
                        out.append(TablePartition(path, shard_number(path), table, old["top"], now["top"]))
        return out

    def read(self, partition: TablePartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition, [], [], partition.rebuilt)

    def commit(self, end: dict) -> None:
        """Nothing is kept of what was read."""


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of the shards in ``folder``; filters on db, tbl and numbers reach SQLite."""
    spark.dataSource.register(MessageShards)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("message_shards").option("push", "true").load(folder)


def stream_shards(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the rows added to the shards in ``folder`` and, with ``rebuilt``, of tables whose older rows have changed."""
    spark.dataSource.register(MessageShardChanges)
    return spark.readStream.format("message_shard_changes").load(folder)


def every(writer: DataStreamWriter, minutes: int) -> DataStreamWriter:
    """``writer`` with a poll each so many minutes; 0 looks once at what is there and ends."""
    return writer.trigger(processingTime=f"{minutes} minutes") if minutes > 0 else writer.trigger(availableNow=True)


def files_of(df: DataFrame) -> DataFrame:
    """(path, mtime, size) of a ``binaryFile`` frame, without reading contents."""
    return df.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))


def media_files(df: DataFrame) -> DataFrame:
    """(path, mtime, size, month, md5, variant, ext) of image and video files named by their hash."""
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^([0-9a-f]{32})(_h|_t|_thumb)?\.(\w+)$", k)
    month = F.regexp_extract("path", r"/(\d{4}-\d{2})/", 1)
    return files_of(df).select("*", month.alias("month"), part(1).alias("md5"), part(2).alias("variant"), part(3).alias("ext")).filter("md5 <> ''")
