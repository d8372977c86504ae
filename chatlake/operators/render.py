"""Exports: rendered lines and documents, one Spark job for all chats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chatlake.functions.scalars import clock, escape_html
from chatlake.operators.messages import ORDER, first_of_day

FORMATS = ("txt", "csv", "json", "md", "html")


def txt_line(ts: Column, sender: Column, text: Column) -> Column:
    return F.concat(F.lit("["), clock(ts), F.lit("] "), sender, F.lit(": "), text)


def md_line(ts: Column, sender: Column, text: Column, new_day: Column) -> Column:
    heading = F.when(new_day, F.concat(F.lit("## "), F.substring(clock(ts), 1, 10), F.lit("\n\n"))).otherwise("")
    return F.concat(heading, F.lit("**"), sender, F.lit("** "), F.substring(clock(ts), 12, 5), F.lit("  \n"), F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("\n"))


CSV_COLUMNS = ("time", "sender", "is_self", "kind", "text")


def csv_line(*cells: Column) -> Column:
    """A row as every reader of CSV takes it: a cell with a comma, a quote or a line break is quoted, its quotes doubled."""
    quoted = lambda x: F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    return F.concat_ws(",", *[quoted(x) for x in cells])


def html_line(ts: Column, sender: Column, text: Column, is_self: Column, new_day: Column, system: Column | None = None) -> Column:
    day = F.when(new_day, F.concat(F.lit('<div class="day">'), F.substring(clock(ts), 1, 10), F.lit("</div>\n"))).otherwise("")
    side = F.when(is_self, "self").otherwise("other")
    bubble = F.concat(day, F.lit('<div class="msg '), side, F.lit('"><b>'), escape_html(sender), F.lit("</b><p>"), escape_html(text), F.lit("</p></div>"))
    return bubble if system is None else F.when(system, F.concat(day, F.lit('<div class="sys">'), escape_html(text), F.lit("</div>"))).otherwise(bubble)


def rendered(messages: DataFrame, fmt: str, begun: DataFrame | None = None) -> DataFrame:
    """``messages`` (chat, ts, dbr, local_id, sender, is_self, kind, text) with ``line`` in a text format.

    ``begun`` (chat, last_ts) are documents that go on: a day they end in has its heading already.
    """
    c = F.col
    line = {
        "txt": txt_line(c("ts"), c("sender"), c("text")),
        "csv": csv_line(clock(c("ts")), c("sender"), F.when(c("is_self"), "1").otherwise("0"), c("kind"), c("text")),
        "json": F.to_json(F.struct("ts", clock(c("ts")).alias("time"), "sender", "is_self", "kind", "text")),
        "md": md_line(c("ts"), c("sender"), c("text"), c("_new")),
        "html": html_line(c("ts"), c("sender"), c("text"), c("is_self"), c("_new"), c("kind") == "system"),
    }
    if fmt not in line:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    if fmt in ("md", "html"):
        begins = first_of_day(messages).select("chat", *ORDER, F.lit(True).alias("_new"))
        if begun is not None:
            day = lambda ts: F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")
            held = begun.select("chat", day(c("last_ts")).alias("_day"))
            begins = begins.join(held, (begins["chat"] == held["chat"]) & (day(c("ts")) == c("_day")), "left_anti")
        messages = messages.join(begins, ["chat", *ORDER], "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    rows = messages
    return rows.withColumn("line", line[fmt]).drop("_new")


def document_rows(messages: DataFrame, fmt: str, begun: DataFrame | None = None) -> DataFrame:
    """(chat, ts, line) in order for ``chat_files``: dealt by ranges of (chat, order), so a large chat is the work of several tasks.

    A CSV begins with a byte-order mark and its header, unless it goes on.
    """
    rows = rendered(messages, fmt, begun).select("chat", *ORDER, F.col("ts").alias("_at"), "line")
    if fmt == "csv":
        kind = {f.name: f.dataType for f in rows.schema.fields}
        chats = rows.select("chat").distinct()
        chats = chats if begun is None else chats.join(begun.select("chat"), "chat", "left_anti")
        least = {c: F.lit(-(2**31)).cast(kind[c]).alias(c) for c in ORDER}
        head = chats.select("chat", *least.values(), F.lit(None).cast(kind["ts"]).alias("_at"), F.lit("\ufeff" + ",".join(CSV_COLUMNS)).alias("line"))
        rows = head.unionByName(rows)
    return rows.repartitionByRange("chat", *ORDER).sortWithinPartitions("chat", *ORDER).select("chat", F.col("_at").alias("ts"), "line")


def with_bundles(messages: DataFrame, items: DataFrame) -> DataFrame:
    """``messages`` with the items (chat, db, local_id, path, depth, sender, text) of a forwarded bundle, two blanks a level deep, under its text."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.coalesce("sender", F.lit("")) != "", F.concat("sender", F.lit(": "))).otherwise(""), F.col("text"))
    key = ["chat", "db", "local_id"]
    # One message's items: at most what one message holds.
    under = items.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("_items"))
    rows = messages.join(under.select(*key, F.array_join(F.transform("_items", lambda x: x["line"]), "\n").alias("_under")), key, "left")
    return rows.withColumn("text", F.concat_ws("\n", "text", "_under")).drop("_under")


def export_messages(messages: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> None:
    """Write every chat's lines in order under ``path/chat=...``; ``append`` is for new rows of text formats.

    Lines are dealt by ranges of (chat, order), so a large chat is several files in order of their names; a new CSV begins
    with a byte-order mark and its header.
    """
    if mode == "append" and fmt in ("html", "json"):
        raise ValueError(f"{fmt} is written anew, not appended to")
    rows = rendered(messages, fmt).select("chat", *ORDER, "line")
    if fmt == "csv" and mode != "append":
        kind = {f.name: f.dataType for f in rows.schema.fields}
        head = rows.select("chat").distinct().select("chat", *[F.lit(-(2**31)).cast(kind[c]).alias(c) for c in ORDER], F.lit("\ufeff" + ",".join(CSV_COLUMNS)).alias("line"))
        rows = head.unionByName(rows)
    ordered = rows.repartitionByRange("chat", *ORDER).sortWithinPartitions("chat", *ORDER)
    ordered.select("chat", "line").write.mode(mode).partitionBy("chat").option("header", False).text(path)


def export_json(messages: DataFrame) -> DataFrame:
    """(chat, part, line): a JSON document ``{"chat": ..., "messages": [...]}`` of each chat as lines, so that no chat is one value.

    ``part`` orders the lines: 0 opens the document, 1 are its messages in order, 2 closes it.
    """
    rows = rendered(messages, "json")
    last = messages.groupBy("chat").agg(F.max(F.struct(*ORDER)).alias("_last"))
    body = rows.join(last, "chat").select("chat", F.lit(1).alias("part"), *ORDER, F.concat("line", F.when(F.struct(*ORDER) == F.col("_last"), "").otherwise(",")).alias("line"))
    none = [F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in ORDER]
    head = last.select("chat", F.lit(0).alias("part"), *none, F.concat(F.lit('{"chat":'), F.to_json(F.struct("chat")), F.lit(',"messages":[')).alias("line"))
    tail = last.select("chat", F.lit(2).alias("part"), *none, F.lit("]}").alias("line"))
    return head.unionByName(body).unionByName(tail)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chat, n, digest) of rows (chat, line) sorted by chat; a digest is carried from line to line, no document is held."""
    chat, n, digest, empty = None, 0, None, True

    def row(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chat], kind), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["chat", "n", "digest"])

    kind = None
    for b in batches:
        kind = b.schema.field("chat").type
        for c, line in zip(b.column("chat").to_pylist(), b.column("line"), strict=True):
            if digest is None or c != chat:
                if digest is not None:
                    yield row(kind)
                chat, n, digest, empty = c, 0, hashlib.md5(), True
            n += 1
            if line.is_valid:
                if not empty:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
                empty = False
    if digest is not None:
        yield row(kind)


def documents(messages: DataFrame, fmt: str) -> DataFrame:
    """(chat, n, digest): how many lines each chat's export has, and a digest of them in order, to tell what changed.

    The digest is that of the whole document, which is one chain: a chat is sorted on disk if need be and read once in one task.
    """
    lines = rendered(messages, fmt).select("chat", *ORDER, "line").repartition("chat").sortWithinPartitions("chat", *ORDER, "line")
    schema = StructType([StructField("chat", messages.schema["chat"].dataType), StructField("n", LongType(), False), StructField("digest", StringType())])
    return lines.select("chat", "line").mapInArrow(_digests, schema)


def fingerprints(messages: DataFrame, fmt: str) -> DataFrame:
    """(chat, n, digest) to tell which documents changed: sums of hashes of each line with its place in the order.

    Sums don't depend on the order of adding, so tasks add up their own rows first and no chat is one task's work.
    """
    place = F.to_json(F.struct(*ORDER))
    h = [F.xxhash64(F.lit(seed), place, F.coalesce("line", F.lit(""))) for seed in (1, 2)]
    halves = [F.sum(part) for x in h for part in (F.shiftright(x, 32), x.bitwiseAND(0xFFFFFFFF))]
    return rendered(messages, fmt).groupBy("chat").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *[s.cast("string") for s in halves]).alias("digest"))
