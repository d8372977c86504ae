"""Landing of other tables, records, incremental exports, the daily job and its states."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from chatlake.operators import attach, daily, enrich, jobs, records, rooms, views
from chatlake.sources import landed, shards


def test_landed_tables_of_files_that_lack_some(spark, tmp_path):
    spark.dataSource.register(landed.LandedTable)
    for number, names in ((0, ["", "me", "bob"]), (10, ["bob"])):
        with sqlite3.connect(tmp_path / f"message_{number}.db") as db:
            db.execute("CREATE TABLE Name2Id (user_name TEXT)")
            db.executemany("INSERT INTO Name2Id VALUES (?)", [(n,) for n in names])
    with sqlite3.connect(tmp_path / "message_2.db") as db:
        db.execute("CREATE TABLE other (x)")
    with sqlite3.connect(tmp_path / "contact.db") as db:
        db.execute("CREATE TABLE contact (username TEXT, remark, local_type)")
        db.executemany("INSERT INTO contact VALUES (?, ?, ?)", [("bob", b"B", "1"), ("eve", None, "x")])
    got = sorted(map(tuple, landed.landed(spark, str(tmp_path), "message_*.db", **landed.NAMES).collect()))
    assert got == [(0, 1, ""), (0, 2, "me"), (0, 3, "bob"), (10, 1, "bob")]
    people = sorted(map(tuple, landed.landed(spark, str(tmp_path), "contact.db", **landed.CONTACTS).collect()))
    assert people == [(None, "bob", 1, None, "B", None, None), (None, "eve", None, None, None, None, None)]
    assert landed.landed(spark, str(tmp_path), "contact.db", **landed.STRANGERS).count() == 0
    assert landed.landed(spark, str(tmp_path), "none_*.db", **landed.POSTS).count() == 0


def test_file_tables_skip_half_written_files(spark, tmp_path):
    for name in ("a" * 32, "a" * 32 + ".tmp", "short", "b" * 32 + ".jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = landed.file_table(spark.read.format("binaryFile").load(str(tmp_path)), "[0-9a-f]{32}")
    assert sorted((r.key[0], r.ext) for r in files.collect()) == [("a", ""), ("b", "jpg")]


def raw_messages(spark, rows):
    return spark.createDataFrame(
        [(c, db, i, t * 10, kind, s, sender, t, content, None, b"p") for c, db, i, kind, s, sender, t, content in rows],
        "chat string, db int, local_id long, server_id long, local_type long, sort_seq long, real_sender_id long, create_time long, content binary, ct int, packed_info binary",
    )


def test_records_of_an_archive(spark):
    ids = spark.createDataFrame([(0, 1, "me"), (0, 2, "alice"), (0, 3, ""), (1, 1, "alice"), (1, 2, "me"), (0, 4, None)], "db int, id long, user_name string")
    people = spark.createDataFrame([("alice", "Alice R"), ("dave", "Dave")], "username string, display string")
    nicks = spark.createDataFrame([("1@chatroom", "alice", "Ally")], "chat string, username string, nick string")
    video = b'dave:\n<msg><videomsg fromusername="dave" playlength="12"/></msg>'
    rows = [
        ("1@chatroom", 1, 1, 1, 5, 1, 150, b"bob:\nold"), ("1@chatroom", 0, 1, 1, 9, 2, 150, b"alice:\nhi"), ("1@chatroom", 0, 2, 1, 1, 1, 151, b"note:\nmine"), ("1@chatroom", 0, 3, 43, 1, 4, 152, video),
        ("1@chatroom", 0, 4, 10000, 1, 3, 153, b"joined"), ("1@chatroom", 0, 5, 3, 1, 3, 154, b'<msg fromusername = "alice"><img/></msg>'), ("1@chatroom", 0, 6, 1, 1, 3, 155, b"1@chatroom:\nself named"),
        ("alice", 0, 1, 1, 1, 2, 10, b"alice:\nkept here"), ("alice", 0, 2, 1, 1, 77, 11, b"who"), ("alice", 0, 3, 11000, 1, 2, 12, b"dropped"), ("alice", 0, 4, 1, 1, 2, 13, b""),
    ]
    got = {(r.chat, r.nth): r for r in records.message_records(raw_messages(spark, rows), ids, people, nicks, "me").collect()}
    room = [(got["1@chatroom", n].sender, got["1@chatroom", n].text) for n in range(1, 8)]
    # The dictionary's name stands before a prefix's, and the older shard comes after its sort_seq.
    assert room == [("Ally", "old"), ("Ally", "hi"), ("我", "note:\nmine"), ("Dave", "[视频]"), ("系统", "[系统消息] joined"), ("Ally", "[图片]"), ("系统", "self named")]
    assert got["1@chatroom", 4].seconds == 12 and got["1@chatroom", 4].packed == b"p" and got["1@chatroom", 1].packed is None
    assert [(got["alice", n].sender, got["alice", n].text) for n in (1, 2)] == [("Alice R", "alice:\nkept here"), ("未知(77)", "who")] and len(got) == 9


def test_sender_in_xml(spark):
    for xml, want in (('<msg fromusername = "a b"/>', "a b"), ("<fromusername><![CDATA[u1]]></fromusername>", "u1"), ("<x tofromusername='n'/>", None), ("", None), (None, None)):
        assert spark.range(1).select(enrich.sender_in_xml(F.lit(xml).cast("string")).alias("x")).first().x == want


def exportable(spark, rows):
    return spark.createDataFrame([(c, 0, 0, i, t, "s", False, "text", x) for c, i, t, x in rows], "chat string, db int, dbr int, local_id long, ts long, sender string, is_self boolean, kind string, text string")


@pytest.mark.parametrize("fmt", ["txt", "csv", "md"])
def test_appending_exports_resume_where_they_ended(spark, tmp_path, fmt):
    out = f"file://{tmp_path}"
    first = [("a", 1, 10, "x"), ("a", 2, 20, "y"), ("b", 1, 5, "z")]
    then = [*first, ("a", 3, 20, "tie"), ("a", 4, 15, "late"), ("c", 1, 1, "new")]
    counts = lambda df: dict(map(tuple, df.collect()))
    assert counts(daily.export_all(exportable(spark, first), fmt, out, "1")) == {"a": 2, "b": 1}
    assert counts(daily.export_all(exportable(spark, then), fmt, out, "2")) == {"a": 1, "c": 1}
    assert counts(daily.export_all(exportable(spark, then), fmt, out, "2")) == {"a": 1, "c": 1}  # a run again replaces its part
    assert counts(daily.export_all(exportable(spark, then), fmt, out, "3")) == {}
    assert counts(daily.export_all(exportable(spark, [*then, ("a", 5, 20, "tie 2")]), fmt, out, "4")) == {"a": 1}
    text = "".join(p.read_text() for p in sorted(tmp_path.glob(f"{fmt}/run=*/chat=a/part-*")))
    assert [x in text for x in ("x", "y", "tie", "tie 2", "late")] == [True, True, True, True, False]


def test_replaced_exports_write_changed_chats_only(spark, tmp_path):
    out = f"file://{tmp_path}"
    rows = [("a", 1, 10, "x"), ("b", 1, 5, "z")]
    counts = lambda df: dict(map(tuple, df.collect()))
    assert counts(daily.export_all(exportable(spark, rows), "html", out, "1")) == {"a": 1, "b": 1}
    assert counts(daily.export_all(exportable(spark, [*rows, ("a", 2, 11, "y")]), "html", out, "2", only=["a"])) == {"a": 1}
    assert [p.name for p in tmp_path.glob("html/run=2/chat=*")] == ["chat=a"]


def test_daily_run_logs_what_it_did(spark, tmp_path):
    out = f"file://{tmp_path}"
    files = spark.createDataFrame([("f1", 1, 5), ("f2", 1, 3)], "path string, mtime long, size long")
    one = daily.run_daily(spark, exportable(spark, [("a", 1, 10, "x"), ("b", 1, 5, "z")]), ["txt", "html"], out, "2024-01-01", files.filter("path = 'f1'"), files)
    assert (one["status"], one["chats_updated"], one["messages_added"], one["to_land"]) == ("ok", 2, 2, 1)
    two = daily.run_daily(spark, exportable(spark, [("a", 1, 10, "x"), ("b", 1, 5, "z"), ("b", 2, 6, "w")]), ["txt", "pdf"], out, "2024-01-02")
    assert (two["status"], two["messages_added"], two["errors"]) == ("error", 1, ["pdf: ValueError"])
    log = jobs.read_log(spark, f"{out}/_log", "job string, time string, status string, seconds double")
    r = daily.run_rollup(log).first()
    assert (r.runs, r.failures, r.last_status) == (2, 1, "error") and r.longest >= r.mean_seconds > 0
    jobs.append_log(daily.access_entry(spark, "search", {"query": "q", "chat": "", "since": None}, 3, 12, "t"), f"{out}/_access")
    line = json.loads("".join(p.read_text() for p in tmp_path.glob("_access/part-*.json")))
    assert line == {"time": "t", "tool": "search", "args": {"query": "q"}, "count": 3, "ms": 12}
    assert daily.needs_refresh(None, 0) and not daily.needs_refresh(100, 399) and daily.needs_refresh(100, 400) and not daily.needs_refresh(None, 5, 0)


def test_states_are_read_from_exported_lines(spark):
    lines = spark.createDataFrame([("a", 1, "[1970-01-01 00:00:10] s: x"), ("a", 2, "second line"), ("a", 3, "[1970-01-01 00:00:20] s: y"), ("a", 4, "[1970-01-01 00:00:20] s: z")], "chat string, pos int, line string")
    assert tuple(daily.export_tail_state(lines, "txt").first()) == ("a", 20, 2, 3)
    with pytest.raises(ValueError):
        daily.export_tail_state(lines, "html")


def test_bookmark_views(spark):
    schema = "id long, ts long, kind string, title string, desc string, url string, tags array<string>, location string, from string, sender string, items array<struct<kind:string,title:string,desc:string,sender_name:string,from:string,sender:string>>"
    item = ("text", "t", "said", "Bo", "bob", None)
    rows = [(1, 5, "chat_record", "", "d", "", [], None, "1@chatroom", "bob", [item] * 203), (2, 6, "link", "x", "", "u", ["a"], "p", "bob", None, [("image", "", "", "", None, None)]), (3, 7, "text", "", "", "", [], None, "me", None, [])]
    marks = spark.createDataFrame(rows, schema)
    names = spark.createDataFrame([("bob", "Bob"), ("1@chatroom", "Room")], "username string, display string")
    got = {r.id: r for r in views.with_sources(marks, names, "me").withColumns({"line": views.source_line(), "said": views.item_lines()}).collect()}
    assert (got[1].sender_name, got[1].chat_name, got[1].line, got[1].is_self) == ("Bob", "Room", "Bob · 群: Room", False)
    assert (got[2].sender_name, got[2].chat_name, got[2].line) == ("Bob", None, "Bob") and (got[3].sender_name, got[3].is_self) == ("我", True)
    assert got[1].said[0] == "Bo: said" and got[2].said == ["[图片]"]
    wanted, hidden = spark.createDataFrame([(1,), (2,), (9,)], "id long"), spark.createDataFrame([("bob",)], "username string")
    assert views.bookmark_detail(marks, wanted, hidden, "me").count() == 0
    detail = {r.id: r for r in views.bookmark_detail(marks, wanted, hidden.limit(0), "me").collect()}
    assert set(detail) == {1, 2} and len(detail[1]["items"]) == 200 and detail[1].items_truncated == 3 and detail[2].items_truncated is None


def test_members_and_nicknames(spark):
    m = spark.createDataFrame([("r", 0, "a", "A1"), ("r", 1, "b", " "), ("s", 0, "b", None)], "room string, pos int, member string, nick string")
    assert [tuple(r) for r in rooms.nicknames(m).collect()] == [("r", "a", "A1")]
    names = spark.createDataFrame([("b", "Bob")], "member string, display string")
    assert sorted(map(tuple, rooms.members_with_names(m, names, 1).collect())) == [("r", 1, "a", "a"), ("s", 1, "b", "Bob")]


def test_videos_need_a_header(spark):
    msg = spark.createDataFrame([("a", 0, 1, 1704500000, "m"), ("a", 0, 2, 1704500000, None)], "chat string, db int, local_id long, ts long, md5 string")
    files = spark.createDataFrame([("m", "", "2024-01", "p1", bytearray(b"????????")), ("m", "", "2020-01", "p0", bytearray(b"\0\0\0\x18ftyp")), ("m", "_thumb", "2019-01", "t", bytearray(b""))], "md5 string, variant string, month string, path string, head binary")
    got = {r.local_id: (r.video, r.poster) for r in attach.locate_videos(msg, files).collect()}
    assert got == {1: (None, "t"), 2: (None, None)}


def test_shard_numbers():
    assert [shards.shard_number(p) for p in ("/x/message_0.db", "message_10.db", "message_fts.db", "biz_message_0.db")] == [0, 10, None, None]
