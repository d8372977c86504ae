import sqlite3

from pyspark.sql import functions as F

from chatlake.operators import bookmarks, feed, jobs, render_records
from chatlake.sources import shards


def test_message_shards(spark, tmp_path):
    spark.dataSource.register(shards.MessageShards)
    for number, rows in ((0, [(1, 1, "hi"), (2, 3, None)]), (10, [(1, 1, b"\x28\xb5")])):
        with sqlite3.connect(tmp_path / f"message_{number}.db") as db:
            extra = "" if number else ", packed_info_data BLOB"
            db.execute(f"CREATE TABLE Msg_a (local_id INTEGER, server_id INTEGER, local_type INTEGER, sort_seq INTEGER, real_sender_id INTEGER, create_time INTEGER, message_content{extra})")
            db.executemany("INSERT INTO Msg_a (local_id, local_type, message_content) VALUES (?, ?, ?)", rows)
            db.execute("CREATE TABLE Name2Id (user_name TEXT)")
    (tmp_path / "message_fts.db").write_bytes(b"")
    df = spark.read.format("message_shards").load(str(tmp_path))
    got = sorted((r.db, r.tbl, r.local_id, bytes(r.content) if r.content is not None else None) for r in df.collect())
    assert got == [(0, "Msg_a", 1, b"hi"), (0, "Msg_a", 2, None), (10, "Msg_a", 1, b"\x28\xb5")]


def test_media_files(spark, tmp_path):
    (tmp_path / "2024-01").mkdir()
    for name in ("a" * 32 + "_h.jpg", "b" * 32 + ".mp4", "note.txt"):
        (tmp_path / "2024-01" / name).write_bytes(b"x")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = sorted((r.month, r.md5[0], r.variant, r.ext, r["size"]) for r in shards.media_files(df).collect())
    assert got == [("2024-01", "a", "_h", "jpg", 1), ("2024-01", "b", "", "mp4", 1)]


def test_record_lines(spark):
    xml = "<p><TimelineObject><id>5</id><username>u</username><createTime>60</createTime><contentDesc>a &lt; b</contentDesc><ContentObject><type>2</type></ContentObject></TimelineObject><LocalExtraInfo><nickname>N</nickname><comment_user_list><user_comment><username>b</username><nickname>Bo</nickname><create_time>5</create_time><content>hey</content></user_comment><user_comment><username>c</username><create_time>6</create_time><content>yo</content><ref_username>b</ref_username></user_comment></comment_user_list></LocalExtraInfo></p>"
    posts = feed.parse_posts(spark.createDataFrame([(5, "u", xml)], "tid long, user_name string, content string"))
    assert render_records.post_lines(posts, "txt").first().line == "[1970-01-01 00:01:00] N [文字]\na < b\n  Bo: hey\n  c: yo"
    assert "a &lt; b" in render_records.post_lines(posts, "html").first().line and "a &lt; b" in render_records.post_lines(posts, "md").first().line
    assert '"id":"5"' in render_records.post_lines(posts, "json").first().line
    names = spark.createDataFrame([("u", "Uma"), ("b", "Other")], "username string, display string")
    assert render_records.with_names(posts, names).first().author == "Uma"
    assert [tuple(r) for r in render_records.reply_names(posts, names).collect()] == [("5", 1, "Bo")]
    xml = "<favitem type='5'><title>T</title><weburlitem><clean_url>https://x.org</clean_url></weburlitem><taglist><tag>w</tag></taglist></favitem>"
    marks = bookmarks.parse_bookmarks(spark.createDataFrame([(1, 5, 60, xml)], "local_id long, type int, update_time long, content string"))
    assert render_records.bookmark_lines(marks, "txt").first().line == "[1970-01-01 00:01:00] [链接] T\nhttps://x.org\n#w"
    assert 'href="https://x.org"' in render_records.bookmark_lines(marks, "html").first().line


def test_compact_view(spark):
    rows = [("a", 0, 0, 1, 60, "x", "text", "hi"), ("a", 0, 0, 2, 90000, "y", "image", "[图片]")]
    df = spark.createDataFrame(rows, "chat string, db int, dbr int, local_id long, ts long, sender string, kind string, text string")
    assert render_records.compact(df).first().view == "-- 1970-01-01\n00:01 x: hi\n-- 1970-01-02\n01:00 y: [图片] #0:2"
    assert render_records.compact(df.filter(F.lit(False))).count() == 0


def test_jobs(spark, tmp_path):
    df = spark.createDataFrame([("u1", "Bob"), ("u2", "Bob"), ("u3", "A/b")], "username string, display string")
    assert dict(map(tuple, jobs.export_names(df, "md").collect())) == {"u1": "Bob_u1_chat.md", "u2": "Bob_u2_chat.md", "u3": "A_b_chat.md"}
    now, old = (spark.createDataFrame(rows, "chat string, digest string") for rows in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "0")]))
    assert sorted(r.chat for r in jobs.changed_documents(now, old).collect()) == ["b", "c"]
    log = f"{tmp_path}/log"
    for row in (("sync", 1, "ok"), ("sync", 3, "failed"), ("export", 2, "ok")):
        jobs.append_log(spark.createDataFrame([row], "job string, time long, status string"), log)
    got = {r.job: (r.last.status, r.runs, r.failures) for r in jobs.last_run(jobs.read_log(spark, log, "job string, time long, status string")).collect()}
    assert got == {"sync": ("failed", 2, 1), "export": ("ok", 1, 0)}
    people = spark.createDataFrame([("p", 1, "contact", 1, "x"), ("p", 2, "stranger", 0, "y"), ("q", 3, "stranger", 0, "z"), ("q", 4, "stranger", 0, "w")], "pattern string, key int, source string, local_type int, display string")
    assert sorted(r.key for r in jobs.prefer_friends(people).collect()) == [1, 3, 4]
    posts = spark.createDataFrame([("u", "1", "Uma"), ("u", "2", "Uma"), ("v", "3", "umar"), ("me1", "4", None)], "username string, id string, nickname string")
    assert [tuple(r) for r in jobs.author_of(posts, "Uma", "me1").collect()] == [("u", 2, 0)]
    assert [tuple(r) for r in jobs.author_of(posts, "我", "me1").collect()] == [("me1", 1, 0)]
    files = spark.createDataFrame([("_h", b"\xff\xd8\xff"), ("_h", b"zz"), ("_t", b"\x89PNG")], "variant string, content binary")
    assert sorted(map(tuple, jobs.media_audit(files, 10).collect())) == [("_h", "bin", 1, 0), ("_h", "jpg", 1, 1), ("_t", "png", 1, 1)]
