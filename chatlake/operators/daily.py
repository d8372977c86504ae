"""Incremental exports and the daily job: what is new since the last export, per format, and one line of log."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators import incremental, jobs, render
from chatlake.sources import chat_files

#: Formats that new lines are appended to; the others are written anew.
APPENDED = ("txt", "csv", "md")
#: How a state is written into a Markdown file, for readers of the file itself.
STATE_NOTE = r"^<!-- state: last=(-?\d+) n=(\d+) -->$"


def state_note(last_ts: Column, n_last: Column) -> Column:
    return F.format_string("<!-- state: last=%d n=%d -->", last_ts, n_last)


def export_tail_state(lines: DataFrame, fmt: str) -> DataFrame:
    """(chat, last_ts, n_last, rendered) read from the lines (chat, pos, line) of exported files in order of ``pos``.

    Text and CSV lines begin with their time, others continue a message; Markdown has notes of its state, of which
    the last one stands.
    """
    if fmt == "md":
        found = lines.filter(F.col("line").rlike(STATE_NOTE)).groupBy("chat").agg(F.max_by("line", "pos").alias("line"))
        part = lambda k: F.regexp_extract("line", STATE_NOTE, k).cast("long")
        return found.select("chat", part(1).alias("last_ts"), part(2).alias("n_last"), F.lit(None).cast("long").alias("rendered"))
    if fmt not in APPENDED:
        raise ValueError(f"{fmt} is written anew and has no state")
    begin = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] " if fmt == "txt" else r"^\ufeff?(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),"
    clock = F.regexp_extract("line", begin, 1)
    times = lines.filter(clock != "").select("chat", F.unix_seconds(F.to_timestamp(clock)).alias("ts"))
    per = times.groupBy("chat", "ts").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("chat").agg(F.max("ts").alias("last_ts"), F.max_by("n", "ts").alias("n_last"), F.sum("n").alias("rendered"))


def rendered_count(lines: DataFrame, fmt: str) -> DataFrame:
    """(chat, rendered): messages in exported HTML or JSON lines."""
    hit = F.col("line").rlike('<div class="(msg|sys)') if fmt == "html" else F.col("line").rlike(r'^\{"ts":')
    return lines.groupBy("chat").agg(F.count_if(hit).alias("rendered"))


def export_all(messages: DataFrame, fmt: str, out: str, run: str, since: int | None = None, until: int | None = None, only: Sequence | None = None) -> DataFrame:
    """Export all chats, or ``only`` some, under ``out/fmt``, and return (chat, n) of new messages.

    Appended formats get a run with the rows that the committed runs don't have: header, byte-order mark and a day's
    heading stand once, whatever the number of runs. The others are written anew for the chats whose fingerprint has changed,
    and the older runs' documents of those go once the run is committed. A run repeated after a failure replaces its own
    part; one that fails leaves what was there (``sources.chat_files``).
    """
    spark = messages.sparkSession
    rows = jobs.exported(messages, since, until)
    rows = rows if only is None else rows.filter(F.col("chat").isin(*only))
    path, kind = f"{out}/{fmt}", messages.schema["chat"].dataType
    before = chat_files.tails(spark, path, without=run)
    before = None if before is None else before.withColumn("chat", F.col("chat").cast(kind))
    if fmt in APPENDED:
        state = None if before is None else chat_files.ends(before)
        new = rows if state is None else incremental.select_new(rows, state)
        chat_files.write_run(render.document_rows(new, fmt, state), path, run)
        written = chat_files.tails(spark, path).filter(F.col("run") == run)
        return written.groupBy(F.col("chat").cast(kind).alias("chat")).agg(F.sum("n").alias("n")).filter("n > 0")
    state_path = f"{out}/_state/{fmt}"
    now = render.fingerprints(rows, fmt)
    states = _states(spark, state_path, run)
    known = None if states is None else states.groupBy("chat").agg(F.max_by(F.struct("digest", "n"), "at").alias("s")).select("chat", "s.*")
    changed = (now if known is None else jobs.changed_documents(now, known)).persist()  # written and counted from one reading
    try:
        again = rows.join(changed.select("chat"), "chat", "left_semi")
        chat_files.write_run(render.document_rows(again, fmt), path, run)
        changed.withColumn("at", F.lit(run)).write.mode("overwrite").parquet(f"{state_path}/run={run}")
        chat_files.forget_older(spark, path, run)
    finally:
        changed.unpersist()
    done = spark.read.parquet(f"{state_path}/run={run}")
    old = done.select("chat").withColumn("_n", F.lit(0)) if known is None else known.select("chat", F.col("n").alias("_n"))
    return done.join(old, "chat", "left").select("chat", F.greatest(F.col("n") - F.coalesce("_n", F.lit(0)), F.lit(0)).alias("n"))


def publish_all(spark: SparkSession, fmt: str, out: str, names: DataFrame, folder: str) -> DataFrame:
    """(chat, file, status): one file a chat in ``folder``, named by ``names`` (chat, file), replaced only where its bytes change.

    A Markdown file ends with a note of its state, made of the same commits as its lines.
    """
    return chat_files.publish(spark, f"{out}/{fmt}", names, folder, newest=fmt not in APPENDED, end=_notes(spark, fmt, out))


def exported_digests(spark: SparkSession, fmt: str, out: str) -> DataFrame:
    """(chat, size, sha256) of every chat's exported document, a Markdown one with its note."""
    held = chat_files.tails(spark, f"{out}/{fmt}")
    return chat_files.document_digests(spark, f"{out}/{fmt}", held.select("chat").distinct(), newest=fmt not in APPENDED, end=_notes(spark, fmt, out))


def _notes(spark: SparkSession, fmt: str, out: str) -> DataFrame | None:
    """(chat, end): what stands behind each document."""
    held = chat_files.tails(spark, f"{out}/{fmt}") if fmt == "md" else None
    return None if held is None else chat_files.ends(held).select("chat", F.concat(state_note(F.col("last_ts"), F.col("n_last")), F.lit("\n")).alias("end"))


def _states(spark: SparkSession, path: str, run: str) -> DataFrame | None:
    """States of other runs; null before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path).filter(F.col("run").cast("string") != run).drop("run")


def needs_refresh(last_refresh: int | None, now: int, minutes: int = 5) -> bool:
    """Whether landed data should be looked at again before a question; 0 minutes means never."""
    return minutes > 0 and (last_refresh is None or now - last_refresh >= 60 * minutes)


def refresh_lists(before: DataFrame, now: DataFrame, landable: Column | None = None) -> DataFrame:
    """(path, status, size): what to land, smallest first; ``failed`` where a changed file can't be."""
    status = incremental.manifest_status(before, now)
    sized = status.join(now.select("path", "size"), "path", "left")
    bad = F.lit(False) if landable is None else ~F.coalesce(landable, F.lit(False))
    return sized.withColumn("status", F.when(F.col("status").isin("new", "changed") & bad, "failed").otherwise(F.col("status"))).orderBy("size", "path")


def sync_stats(plan: DataFrame, added: DataFrame) -> DataFrame:
    """(checked, appended, rebuilt, dropped, added) of a sync plan (chat, action) and the rows added per chat (chat, n)."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.join(added, "chat", "left").agg(F.count(F.lit(1)).alias("checked"), n("append").alias("appended"), n("rebuild").alias("rebuilt"), n("drop").alias("dropped"), F.coalesce(F.sum("n"), F.lit(0)).alias("added"))


def scoped_plan(plan: DataFrame, only: DataFrame) -> DataFrame:
    """The part of a sync plan that some chats (chat) need; chats outside are left as they are, so none is dropped."""
    return plan.join(only.select("chat").distinct(), "chat", "left_semi")


def plan_for_version(plan: DataFrame, stored: tuple, wanted: tuple) -> DataFrame:
    """``plan``, with everything rebuilt where the stored (version, account) isn't the wanted one."""
    return plan if stored == wanted else plan.withColumn("action", F.when(F.col("action") == "drop", "drop").otherwise("rebuild"))


def run_rollup(log: DataFrame) -> DataFrame:
    """(job, runs, failures, last_time, last_status, mean_seconds, longest) of a run log (job, time, status, seconds)."""
    last = F.max_by("status", "time")
    return log.filter("time is not null").groupBy("job").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") != "ok").alias("failures"), F.max("time").alias("last_time"), last.alias("last_status"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("longest"))


def access_entry(spark: SparkSession, tool: str, args: dict, count: int, ms: int, at: str, error: str | None = None) -> DataFrame:
    """One access-log row: time, tool, arguments without empty ones, result count, milliseconds, error; never any content."""
    kept = {k: str(v) for k, v in args.items() if v not in (None, "")}
    return spark.createDataFrame([(at, tool, kept, count, ms, error)], "time string, tool string, args map<string,string>, count long, ms long, error string")


def run_daily(spark: SparkSession, messages: DataFrame, formats: Sequence[str], out: str, run: str, before: DataFrame | None = None, files: DataFrame | None = None) -> dict:
    """Refresh lists, exports in every format, one row of log under ``out/_log``; the entry is returned.

    A format that fails is noted and the others go on; chats and messages count as in the format with the most.
    """
    began = time.monotonic()
    entry = {"job": "daily", "time": run, "status": "ok", "chats_updated": 0, "messages_added": 0, "errors": [], "to_land": 0}
    if files is not None:
        known = before if before is not None else files.limit(0)
        entry["to_land"] = refresh_lists(known, files).filter(F.col("status").isin("new", "changed")).count()
    for fmt in formats:
        try:
            total = incremental.export_totals(export_all(messages, fmt, out, run)).first()
            entry["chats_updated"] = max(entry["chats_updated"], total.changed_chats)
            entry["messages_added"] = max(entry["messages_added"], total.total_new)
        except Exception as e:  # noqa: BLE001  one format's failure is logged, as the others are still wanted
            entry["errors"].append(f"{fmt}: {type(e).__name__}")
    entry["status"] = "error" if entry["errors"] else "ok"
    entry["seconds"] = round(time.monotonic() - began, 1)
    jobs.append_log(spark.createDataFrame([entry], "job string, time string, status string, chats_updated long, messages_added long, errors array<string>, to_land long, seconds double"), f"{out}/_log")
    return entry
