"""Exports as a sink: appended runs against one full export, byte for byte; what a failed or repeated run leaves."""

import os

import pytest
from pyspark.sql import functions as F

from chatlake.operators import daily, jobs, render
from chatlake.sources import chat_files
from tests.test_jobs import exportable

DAY = 86400
ROWS = [("a", 1, 10, "x"), ("a", 2, 20, "y, \"q\""), ("b", 1, DAY + 5, "<z>"), ("a", 3, 20, "tie"), ("a", 4, DAY + 1, "next\nday"), ("c d/é", 1, 1, "new"), ("b", 2, DAY + 9, "same day"), ("b", 3, 3 * DAY, "later"), ("a", 5, DAY + 2, "w")]


def names(spark, fmt):
    return spark.createDataFrame([(c, f"{i}.{fmt}") for i, c in enumerate(("a", "b", "c d/é"))], "chat string, file string")


def published(spark, tmp_path, fmt, out):
    got = {r.chat: r.status for r in daily.publish_all(spark, fmt, out, names(spark, fmt), f"{tmp_path}/published-{os.path.basename(out)}").collect()}
    folder = tmp_path / f"published-{os.path.basename(out)}"
    return got, {p.name: p.read_bytes() for p in folder.iterdir()}


@pytest.mark.parametrize("fmt", ["txt", "csv", "md"])
def test_appended_runs_equal_one_full_export(spark, tmp_path, fmt):
    runs, whole = f"{tmp_path}/runs", f"{tmp_path}/whole"
    for k, upto in enumerate((2, 3, 6, 9)):
        daily.export_all(exportable(spark, ROWS[:upto]), fmt, runs, f"r{k}")
    daily.export_all(exportable(spark, ROWS), fmt, whole, "one")
    got, files = published(spark, tmp_path, fmt, runs)
    assert set(got.values()) == {"written"}
    assert files == published(spark, tmp_path, fmt, whole)[1]
    text = files[f"0.{fmt}"].decode()
    assert text.count("tie") == 1 and len(files) == 3
    if fmt == "csv":
        assert text.startswith("﻿time,") and text.count("﻿") == 1 == text.count("time,sender")
    if fmt == "md":
        assert text.count("## 1970-01-01") == 1 == text.count("## 1970-01-02") and text.endswith("<!-- state: last=86402 n=1 -->\n")
        state = daily.export_tail_state(spark.createDataFrame([("a", i, x) for i, x in enumerate(text.splitlines())], "chat string, pos int, line string"), "md").first()
        assert (state.last_ts, state.n_last) == (86402, 1)


@pytest.mark.parametrize("fmt", ["html", "json"])
def test_one_document_a_chat_after_a_change(spark, tmp_path, fmt):
    out = f"{tmp_path}/out"
    daily.export_all(exportable(spark, ROWS[:6]), fmt, out, "r1")
    first, files = published(spark, tmp_path, fmt, out)
    folder = tmp_path / "published-out"
    times = {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}
    edited = [*ROWS[:3], ("a", 3, 20, "tie, edited"), *ROWS[4:6]]
    assert dict(map(tuple, daily.export_all(exportable(spark, edited), fmt, out, "r2").collect())) == {"a": 0}
    kept = sorted(p.relative_to(tmp_path / "out" / fmt).parts[:2] for p in (tmp_path / "out" / fmt).glob("run=*/chat=*"))
    assert [c for _, c in kept].count("chat=a") == 1 and ("run=r2", "chat=a") in kept and len(kept) == 3
    second, after = published(spark, tmp_path, fmt, out)
    assert second == {"a": "written", "b": "unchanged", "c d/é": "unchanged"}
    assert {n for n in files if files[n] != after[n]} == {f"0.{fmt}"} and b"tie, edited" in after[f"0.{fmt}"]
    assert all(p.stat().st_mtime_ns == times[p.name] for p in folder.iterdir() if p.name != f"0.{fmt}")
    assert daily.export_all(exportable(spark, edited), fmt, out, "r3").count() == 0


def test_failed_and_repeated_runs(spark, tmp_path):
    out = f"{tmp_path}/out"
    daily.export_all(exportable(spark, ROWS[:3]), "txt", out, "r1")
    document = b"".join(chat_files.assembled(f"{out}/txt", "a"))
    fail = F.udf(lambda x: 1 // 0 if x == "next\nday" else x)
    rows = exportable(spark, ROWS).repartition(4)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        daily.export_all(rows.withColumn("text", fail("text")), "txt", out, "r2")
    assert b"".join(chat_files.assembled(f"{out}/txt", "a")) == document and list(chat_files.commits(f"{out}/txt")) == ["r1"]
    for _ in range(2):
        assert dict(map(tuple, daily.export_all(rows, "txt", out, "r2").collect())) == {"a": 3, "b": 2, "c d/é": 1}
        assert b"".join(chat_files.assembled(f"{out}/txt", "a")).count(b"\n") == 6  # one text has a line break
    gone = chat_files.vacuum(f"{out}/txt")
    assert any("run=r2" in g for g in gone) and not any("run=r1" in g for g in gone)
    assert b"".join(chat_files.assembled(f"{out}/txt", "a")).count(b"\n") == 6 and chat_files.vacuum(f"{out}/txt") == []


def test_a_large_chat_is_several_ordered_parts(spark, tmp_path):
    rows = exportable(spark, [("a", i, 1 + i // 3, f"m{i}") for i in range(3000)])
    chat_files.write_run(render.document_rows(rows, "txt").sparkSession.createDataFrame([], "chat string, ts long, line string"), f"{tmp_path}/none", "r")
    assert chat_files.tails(spark, f"{tmp_path}/none") is None
    ordered = render.rendered(rows, "txt").repartitionByRange(4, "chat", "ts", "dbr", "local_id").sortWithinPartitions("chat", "ts", "dbr", "local_id")
    chat_files.write_run(ordered.select("chat", "ts", "line"), f"{tmp_path}/txt", "r")
    assert len(chat_files.parts_of(f"{tmp_path}/txt", "a", chat_files.commits(f"{tmp_path}/txt"))) > 1
    lines = b"".join(chat_files.assembled(f"{tmp_path}/txt", "a")).decode().splitlines()
    assert [x.split(": ")[1] for x in lines] == [f"m{i}" for i in range(3000)]


def test_fingerprints_see_edits_and_order(spark):
    base = [("a", 1, 10, "x"), ("a", 2, 20, "y"), ("b", 1, 5, "z")]
    digest = lambda rows: {r.chat: (r.n, r.digest) for r in render.fingerprints(exportable(spark, rows), "html").collect()}
    want = digest(base)
    assert digest(base[::-1]) == want
    assert {c for c, d in digest([("a", 1, 10, "y"), ("a", 2, 20, "x"), base[2]]).items() if d != want[c]} == {"a"}
    assert jobs.changed_documents(render.fingerprints(exportable(spark, base), "html"), render.fingerprints(exportable(spark, base), "html")).count() == 0


def test_digests_of_few_names_are_the_work_of_several_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.format_string("c%03d", "id").alias("chat"), F.col("id").alias("ts"), F.lit("x").alias("line"))
    chat_files.write_run(rows.coalesce(1), f"{tmp_path}/out", "1")
    held = chat_files.tails(spark, f"{tmp_path}/out").select("chat").distinct()
    got = chat_files.document_digests(spark, f"{tmp_path}/out", held).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 400 and {r.size for r in got} == {2} and len({r.task for r in got}) == 4
