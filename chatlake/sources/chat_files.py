"""Exports as a sink: ordered text files for each chat, committed run by run.

    ordered.write.format("chat_files").option("run", "2024-05-01").option("fmt", "csv").mode("append").save("/exports/csv")
    publish(spark, "/exports/csv", names, "/published")

Rows (chat, ts, line) come dealt by ranges of (chat, order) and sorted in each task; a null ts marks a line that is no message. A task
writes each chat's lines to ``run=R/chat=C/part-P.A`` and its chats' ends to ``_tails``; P is the task's place, A its attempt. What a
run wrote counts once ``_commits/R`` names its attempts: that file is written under another name and moved, so a run is there as a
whole or not at all, a failed one or a lost attempt is never read, and a run done again takes its own place. The driver
sees a pair of numbers a task. A chat's document is its parts in order of run and place.

``publish`` makes one file a chat of them, in tasks, and replaces a file only where its bytes change. Folders must be within every
machine's reach, by any file system that Arrow opens.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

TAIL = "chat string, last_ts long, n_last long, n long"
NO_CHAT = "__HIVE_DEFAULT_PARTITION__"
BLOCK = 1 << 20


def folder_of(chat: str | None) -> str:
    return "chat=" + (NO_CHAT if chat is None else quote(chat, safe=" @-_.,+~"))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class _Part(WriterCommitMessage):
    place: int
    attempt: int
    rows: int


class ChatFiles(DataSource):
    """Options: ``path``, ``run``."""

    @classmethod
    def name(cls) -> str:
        return "chat_files"

    def schema(self) -> str:
        return "chat string, ts long, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["run"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        place, attempt = context.partitionId(), context.taskAttemptId()
        store, root = opened(self.path)
        home = f"{root}/run={self.run}"
        tails: list[tuple] = []
        file, chat, last, n_last, n, total = None, None, None, 0, 0, 0

        def closed() -> None:
            file.close()
            tails.append((chat, last, n_last, n))

        for b in iterator:
            for c, ts, line in zip(*(b.column(k).to_pylist() for k in ("chat", "ts", "line")), strict=True):
                if file is None or c != chat:
                    if file is not None:
                        closed()
                    chat, last, n_last, n = c, None, 0, 0
                    store.create_dir(f"{home}/{folder_of(c)}", recursive=True)
                    file = store.open_output_stream(f"{home}/{folder_of(c)}/part-{place:06d}.{attempt}")
                file.write(((line or "") + "\n").encode())
                if ts is not None:
                    n, n_last, last, total = n + 1, n_last + 1 if ts == last else 1, ts, total + 1
        if file is not None:
            closed()
            store.create_dir(f"{root}/_tails/run={self.run}", recursive=True)
            columns = [pa.array([t[0] for t in tails], pa.string()), *(pa.array([t[k] for t in tails], pa.int64()) for k in (1, 2, 3))]
            with store.open_output_stream(f"{root}/_tails/run={self.run}/{place:06d}.{attempt}.parquet") as out:
                pq.write_table(pa.Table.from_arrays(columns, ["chat", "last_ts", "n_last", "n"]), out)
        return _Part(place, attempt, total)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        before = commits(self.path)
        number = before[self.run]["number"] if self.run in before else 1 + max((c["number"] for c in before.values()), default=0)
        entry = {"number": number, "rows": sum(m.rows for m in messages if m), "parts": {str(m.place): m.attempt for m in messages if m}}
        store.create_dir(f"{root}/_commits", recursive=True)
        hidden = f"{root}/_commits/.{self.run}.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps(entry).encode())
        store.move(hidden, f"{root}/_commits/{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What the tasks wrote is in no commit, so nobody reads it; ``vacuum`` deletes it."""


def commits(path: str) -> dict[str, dict]:
    """The committed runs in order: of each its number, rows, and the attempt that counts at each place."""
    store, root = opened(path)
    found = {}
    for info in store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)):
        if not info.base_name.startswith("."):
            with store.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    return dict(sorted(found.items(), key=lambda x: x[1]["number"]))


def dealt(chats: DataFrame) -> DataFrame:
    """``chats`` (chat, once each) over as many tasks as shuffles have: few bytes stand for many files, so the engine would join them to one task.

    Dealt without a key: by (chat) they are dealt already, and that shuffle may be joined.
    """
    spark = chats.sparkSession
    return chats.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """Write sorted ``rows`` (chat, ts, line) as a run of the documents under ``path``."""
    rows.sparkSession.dataSource.register(ChatFiles)
    rows.select(F.col("chat").cast("string").alias("chat"), F.col("ts").cast("long").alias("ts"), "line").write.format("chat_files").option("run", run).mode("append").save(path)


def tails(spark: SparkSession, path: str, without: str | None = None) -> DataFrame | None:
    """(chat, run, number, last_ts, n_last, n) of every committed run but ``without``; null before the first."""
    runs = {r: c for r, c in commits(path).items() if r != without}
    store, root = opened(path)
    there = [r for r in runs if store.get_file_info(f"{root}/_tails/run={r}").type != fs.FileType.NotFound]
    if not there:
        return None
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]*)/(\d+)\.(\d+)\.parquet$", 1)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)\.(\d+)\.parquet$", k).cast("long")
    rows = spark.read.schema(TAIL).parquet(*(f"{path}/_tails/run={r}" for r in there)).select("*", F.url_decode(name).alias("run"), part(1).alias("_place"), part(2).alias("_attempt"))
    parts = [(r, c["number"], int(p), a) for r, c in runs.items() for p, a in c["parts"].items()]  # a pair of numbers a task
    return rows.join(spark.createDataFrame(parts, "run string, number long, _place long, _attempt long"), ["run", "_place", "_attempt"]).drop("_place", "_attempt")


def ends(tails: DataFrame) -> DataFrame:
    """(chat, last_ts, n_last): where each chat's document ends, over all its runs."""
    per = tails.filter("last_ts is not null").groupBy("chat", "last_ts").agg(F.sum("n_last").alias("n_last"))
    return per.groupBy("chat").agg(F.max("last_ts").alias("last_ts"), F.max_by("n_last", "last_ts").alias("n_last"))


def parts_of(path: str, chat: str | None, runs: dict[str, dict], newest: bool = False) -> list[str]:
    """The files of a chat's document in order, of its newest run alone if ``newest``."""
    store, root = opened(path)
    out: list[str] = []
    for run, commit in runs.items():
        own = []
        for info in store.get_file_info(fs.FileSelector(f"{root}/run={run}/{folder_of(chat)}", allow_not_found=True)):
            place, attempt = info.base_name.removeprefix("part-").split(".")
            if commit["parts"].get(str(int(place))) == int(attempt):
                own.append(info.path)
        out = sorted(own) if newest and own else out if newest else out + sorted(own)
    return out


def assembled(path: str, chat: str | None, runs: dict[str, dict] | None = None, newest: bool = False, end: str = "") -> Iterator[bytes]:
    """A chat's document, block by block, and ``end`` behind it."""
    store, _ = opened(path)
    for p in parts_of(path, chat, commits(path) if runs is None else runs, newest):
        with store.open_input_stream(p) as f:
            while block := f.read(BLOCK):
                yield block
    if end:
        yield end.encode()


def _digest(blocks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for b in blocks:
        h.update(b)
    return h.hexdigest()


def _file_blocks(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            yield block


def _published(path: str, out: str, runs: dict[str, dict], newest: bool):
    def put(chat: str | None, file: str, end: str) -> str:
        store, root = opened(out)
        target, hidden = f"{root}/{file}", f"{root}/.{uuid.uuid4().hex}.tmp"
        document = lambda: assembled(path, chat, runs, newest, end)
        if store.get_file_info(target).type == fs.FileType.File and _digest(_file_blocks(store, target)) == _digest(document()):
            return "unchanged"
        store.create_dir(root, recursive=True)
        try:
            with store.open_output_stream(hidden) as f:
                for block in document():
                    f.write(block)
            store.move(hidden, target)
        except OSError:
            if store.get_file_info(hidden).type == fs.FileType.File:
                store.delete_file(hidden)
            return "failed"  # the old file is still there
        return "written"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(status=[put(c, n, e) for c, n, e in zip(f["chat"], f["file"], f["end"], strict=True)])[["chat", "file", "status"]]

    return run


def publish(spark: SparkSession, path: str, names: DataFrame, out: str, newest: bool = False, end: DataFrame | None = None) -> DataFrame:
    """(chat, file, status) of each chat in ``names`` (chat, file): one file in ``out``, written, unchanged or failed.

    ``newest`` takes a chat's newest run alone, for formats that are written anew; ``end`` (chat, end) is put behind a document.
    """
    rows = names.select(F.col("chat").cast("string").alias("chat"), "file")
    rows = rows.withColumn("end", F.lit("")) if end is None else rows.join(end.select(F.col("chat").cast("string").alias("chat"), "end"), "chat", "left").fillna("", ["end"])
    return dealt(rows).mapInPandas(_published(path, out, commits(path), newest), "chat string, file string, status string")


def document_digests(spark: SparkSession, path: str, chats: DataFrame, newest: bool = False, end: DataFrame | None = None) -> DataFrame:
    """(chat, size, sha256) of the documents of ``chats`` (chat), read block by block in tasks."""
    runs = commits(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size, digest = [], []
            for chat, tail in zip(f["chat"], f["end"], strict=True):
                h, n = hashlib.sha256(), 0
                for block in assembled(path, chat, runs, newest, tail):
                    h.update(block)
                    n += len(block)
                size.append(n)
                digest.append(h.hexdigest())
            yield pd.DataFrame({"chat": f["chat"], "size": size, "sha256": digest})

    rows = chats.select(F.col("chat").cast("string").alias("chat"))
    rows = rows.withColumn("end", F.lit("")) if end is None else rows.join(end.select(F.col("chat").cast("string").alias("chat"), "end"), "chat", "left").fillna("", ["end"])
    return dealt(rows).mapInPandas(run, "chat string, size long, sha256 string")


def forget_older(spark: SparkSession, path: str, run: str) -> int:
    """Delete the older runs' parts of the chats that ``run`` has, once it is committed; returns how many folders went."""
    runs = commits(path)
    older = [r for r in runs if runs[r]["number"] < runs[run]["number"]]
    own = tails(spark, path)
    if own is None or not older:
        return 0

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(path)
        for f in frames:
            gone = 0
            for chat in f["chat"]:
                for r in older:
                    home = f"{root}/run={r}/{folder_of(chat)}"
                    if store.get_file_info(home).type == fs.FileType.Directory:
                        store.delete_dir(home)
                        gone += 1
            yield pd.DataFrame({"gone": [gone]})

    return dealt(own.filter(F.col("run") == run).select("chat").distinct()).mapInPandas(drop, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]


def vacuum(path: str) -> list[str]:
    """Delete what no commit names, of runs that nobody is writing; returns the runs' folders and parts that went."""
    store, root = opened(path)
    runs, gone = commits(path), []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        run = next((x.removeprefix("run=") for x in info.path.split("/") if x.startswith("run=")), None)
        if info.type != fs.FileType.File or run is None:
            continue
        place, attempt = info.base_name.removeprefix("part-").removesuffix(".parquet").split(".")
        if run not in runs or runs[run]["parts"].get(str(int(place))) != int(attempt):
            store.delete_file(info.path)
            gone.append(info.path.removeprefix(root + "/"))
    return sorted(gone)
