"""Jobs around exports and syncs: names of artefacts, what changed, logs, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import safe_filename
from chatlake.operators.media import format_of
from chatlake.operators.messages import in_range


def export_names(chats: DataFrame, fmt: str, incremental: bool = False) -> DataFrame:
    """(username, filename): the display name, with the username where two chats share it; full and incremental exports differ."""
    shared = F.count(F.lit(1)).over(Window.partitionBy("display")) > 1
    name = F.when(F.col("shared"), F.concat("display", F.lit("_"), "username")).otherwise(F.col("display"))
    end = "" if incremental else "_chat"
    return chats.withColumn("shared", shared).select("username", F.concat(safe_filename(name, fallback=safe_filename(F.col("username"))), F.lit(f"{end}.{fmt}")).alias("filename"))


def changed_documents(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (chat, digest) of ``now`` whose digest ``stored`` doesn't have: all that a re-render has to replace."""
    return now.join(stored.select("chat", "digest"), ["chat", "digest"], "left_anti")


def last_run(log: DataFrame) -> DataFrame:
    """(job, last, runs, failures): the last entry of each job in a run log (job, time, status)."""
    last = F.max_by(F.struct("time", "status"), F.struct("time", "status"))
    return log.filter(F.col("time").isNotNull()).groupBy("job").agg(last.alias("last"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") != "ok").alias("failures"))


def append_log(entry: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines; nulls and empty values are left out, texts of messages never go in."""
    entry.write.mode("append").json(path)


def log_reading(spark: SparkSession, seen: Observation, path: str, job: str, at: str) -> dict:
    """Append what a reading counted to the log under ``path`` and return it; the action that read must have ended.

    The counts come from the reading itself (``feed.load_posts``, ``bookmarks.load_bookmarks``), so nothing is read again for the log.
    """
    counts = seen.get
    entry = {"job": job, "time": at, "status": "partial" if counts["failed"] else "ok", **counts}
    append_log(spark.createDataFrame([entry], "job string, time string, status string, rows long, parsed long, failed long"), path)
    return entry


def read_log(spark, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that can't be parsed are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def exported(messages: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Messages of an export's time range: from ``since`` on, before ``until``."""
    ts = F.col("ts")
    if since is not None and until is not None:
        return messages.filter(in_range(ts, since, until, half_open=True))
    return messages.filter((ts >= since) if since is not None else (ts < until)) if (since is not None or until is not None) else messages


def recently_failed(attempts: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(md5) of fetches that failed within ``days``; older failures are forgotten."""
    return attempts.filter(F.col("failed_at") > now - days * 86400).select("md5").distinct()


def media_audit(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(variant, format, files, complete): a sample of ``n`` files (variant, content) by the formats that their first bytes tell."""
    sample = files.orderBy(F.rand(seed)).limit(n).withColumn("format", format_of(F.col("content")))
    return sample.groupBy("variant", "format").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("format") != "bin").alias("complete"))


def prefer_friends(candidates: DataFrame) -> DataFrame:
    """Of a pattern's equally good candidates (pattern, key, source, local_type, display), the one friend or group if there is just one."""
    w = Window.partitionBy("pattern")
    friend = (F.col("source") == "contact") & F.col("local_type").isin(1, 2)
    marked = candidates.withColumn("_friend", friend).withColumn("_friends", F.count_if("_friend").over(w))
    return marked.filter((F.col("_friends") != 1) | F.col("_friend")).drop("_friend", "_friends")


def author_of(posts: DataFrame, text: str, own: str, self_names: tuple[str, ...] = ("我", "me", "self")) -> DataFrame:
    """(username, n, rank): authors that ``text`` names, oneself by an alias; equal, equal but for case, part of a name; the best rank only."""
    name = F.col("name")
    named = posts.select("username", "id", F.explode(F.array("username", F.coalesce("nickname", F.lit("")))).alias("name")).filter(name != "")
    rank: Column = F.when(name == text, 0).when(F.lower(name) == text.lower(), 1).when(F.contains(F.lower(name), F.lit(text.lower())), 2)
    if text.lower() in self_names:
        rank = F.when(F.col("username") == own, 0)
    per = named.withColumn("rank", rank).filter("rank is not null").groupBy("username").agg(F.count_distinct("id").alias("n"), F.min("rank").alias("rank"))
    # The best rank is one number; joining it keeps authors in their own tasks.
    best = per.agg(F.min("rank").alias("_best"))
    return per.join(F.broadcast(best), per["rank"] == best["_best"]).drop("_best")


def author_candidates(posts: DataFrame, text: str, own: str, limit: int = 20) -> DataFrame:
    """(username, n, rank) of ``author_of``, those with the most posts first, ``limit`` at most: what to ask back where a name is ambiguous."""
    return author_of(posts, text, own).orderBy(F.col("n").desc(), "username").limit(limit)
