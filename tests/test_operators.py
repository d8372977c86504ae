"""Behaviour that the given tables don't show: ties, nulls, ladders, late rows, formats."""

import pytest
from pyspark.sql import functions as F

from chatlake.functions import scalars as S
from chatlake.operators import bookmarks, chats, feed, incremental, media, messages, render, rooms, search
from chatlake.streaming import tail


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,end,want",
    [
        ("1700000000", False, 1700000000), ("2024-01-02", False, 1704153600), ("2024-01-02", True, 1704239999), ("2024-01-02 03:04:05", False, 1704164645),
        ("2024-01-02T03:04:05+08:00", False, 1704135845), ("30m", False, 998200), (" 30 m ", False, 998200), ("2024/01/02", False, 1704153600), ("12h", False, 956800), ("7d", False, 395200), ("2w", False, -209600), ("soon", False, None), ("", False, None),
    ],
)
def test_parse_time(spark, text, end, want):
    assert value(spark, S.parse_time(F.lit(text), F.lit(1000000), end)) == want


@pytest.mark.parametrize("n,want", [(None, ""), (-1, ""), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3072.0 GB")])
def test_human_size(spark, n, want):
    assert value(spark, S.human_size(F.lit(n).cast("long"))) == want


def test_scalars(spark):
    assert value(spark, S.one_line(F.lit(" a　\n b  c "), 4)) == "a b…"
    assert value(spark, S.unsigned_id(F.lit(-3574554073709551615))) == "14872190000000000001"
    assert value(spark, S.hms_seconds(F.lit("1:02:03"))) == 3723
    assert value(spark, S.clock(F.lit(0))) is None
    assert value(spark, S.duration_label(F.lit(65))) == "1:05" and value(spark, S.duration_label(F.lit(9))) == '9"'
    assert value(spark, S.url_host(F.lit("HTTPS://u@A.org:8080/x"))) == "a.org" and value(spark, S.safe_url(F.lit("javascript:x"))) is None
    assert value(spark, S.safe_filename(F.lit('a/b:"c"?'))) == "a_b__c__"
    assert value(spark, S.pick_name(F.lit("u"), F.lit("  "), F.lit(" nick "))) == "nick"


def test_snippets(spark):
    long = "x" * 100 + "Needle" + "y" * 100
    assert value(spark, S.snippet(F.lit("a  b\nneedle"), ["needle"])) == "a  b\nneedle"
    assert value(spark, S.snippet(F.lit("z" * 140), ["none"])) == "z" * 140
    assert value(spark, S.snippet(F.lit("z" * 141), ["none"])) == "z" * 120 + "…"
    assert value(spark, S.snippet(F.lit(long), ["none", "NEEDLE"])) == "…" + "x" * 60 + "Needle" + "y" * 54 + "…"
    assert value(spark, S.snippet(F.lit("needle" + "y" * 200), ["needle"])) == "needle" + "y" * 54 + "…"
    assert value(spark, S.snippet(F.lit(None).cast("string"), ["a"])) == ""


def test_file_names_and_paths(spark):
    assert value(spark, S.safe_filename(F.lit(" .. a\x7fb. "))) == "a_b" and value(spark, S.safe_filename(F.lit(" . "))) == "unnamed"
    assert value(spark, S.safe_filename(F.lit(None).cast("string"), fallback=F.lit("u"))) == "u"
    assert value(spark, S.relative_path(F.lit("/out/c_files/a b#.jpg"), F.lit("/out/"), quoted=True)) == "c_files/a%20b%23.jpg"
    assert value(spark, S.relative_path(F.lit("C:\\out\\x.jpg"), F.lit("C:/out"))) == "x.jpg"
    assert value(spark, S.link_text(F.lit("a [b]\n<c>"))) == "a \\[b\\] &lt;c>"
    assert value(spark, S.voice_stem(F.lit(0), F.lit(5), F.lit(7))) == "5_7" and value(spark, S.voice_stem(F.lit(9), F.lit(5), F.lit(7))) == "9"
    assert tuple(value(spark, S.parse_message_id(F.lit(" 2:15 ")))) == (2, 15) and value(spark, S.parse_message_id(F.lit("2:x"))) is None
    assert value(spark, S.host_allowed(F.lit("a.b.com"), ["b.com"])) and not value(spark, S.host_allowed(F.lit("xb.com"), ["b.com"]))


def test_csv_is_read_back_by_csv_readers(spark):
    import csv
    import io

    cells = ['a "b", c', "line\r\nbreak", " lead", "", None, "plain"]
    line = value(spark, render.csv_line(*[F.lit(c).cast("string") for c in cells]))
    assert next(csv.reader(io.StringIO(line, newline=""))) == [c or "" for c in cells]


def test_unnamed_rooms(spark):
    """Oneself is left out; up to three others are named, more are counted with oneself."""
    rows = [("g1", i, u) for i, u in enumerate(["me", "a", "b", "c"])] + [("g2", i, u) for i, u in enumerate(["a", "b", "me", "c", "d"])] + [("g3", 0, "me")]
    names = spark.createDataFrame([("a", "Alice")], "member string, display string")
    got = dict(map(tuple, rooms.unnamed_room_names(spark.createDataFrame(rows, "room string, pos int, member string"), F.col("member") == "me", names).collect()))
    assert got == {"g1": "Alice、b、c", "g2": "Alice、b、c等5人"}


def test_context_tells_shards_apart(spark):
    df = frame(spark, [("a", 0, 0, 1, 10), ("a", 1, -1, 1, 5), ("a", 1, -1, 2, 6), ("b", 0, 0, 1, 1)])
    got = messages.context(df, df.filter("chat = 'a' and db = 1 and local_id = 1"), 1, 1).collect()
    assert sorted((r.db, r.local_id, r.distance) for r in got) == [(1, 1, 0), (1, 2, 1)]


def test_cursors_and_envelopes(spark):
    df = frame(spark, [("a", i % 2, -(i % 2), i, 100 + i // 3) for i in range(12)] + [("b", 0, 0, 1, 1)])
    at = messages.with_cursor(df, spark.createDataFrame([("a", "1:7"), ("b", "0:9")], "chat string, cursor string"))
    assert {r.chat for r in at.collect()} == {"a"}
    part = messages.page(at, 3, before=F.col("at"))
    e = messages.page_envelope(df, part).first()
    rows = sorted(((r.ts, r.dbr, r.local_id) for r in df.collect() if r.chat == "a"))
    cut = rows[: rows.index((102, -1, 7))][-3:]
    assert (e["count"], e.has_more_before, e.has_more_after) == (3, True, True)
    assert (e.before_cursor, e.after_cursor) == tuple(f"{-k[1]}:{k[2]}" for k in (cut[0], cut[-1]))
    some = messages.limited(df, 4, F.col("ts"), F.col("local_id")).collect()
    assert len(some) == 4 and all(r.has_more for r in some) and not messages.limited(df, 13, F.col("ts")).first().has_more


def test_display_cascade(spark):
    rows = [("1@chatroom", "me", 1), ("1@chatroom", "", 2), ("1@chatroom", None, 3), ("1@chatroom", "a", 4), ("1@chatroom", "b", 5), ("a", "a", 6)]
    df = spark.createDataFrame(rows, "chat string, sender_user string, real_sender_id long")
    people = spark.createDataFrame([("a", "Alice")], "username string, display string")
    nicks = spark.createDataFrame([("1@chatroom", "a", "Ally"), ("1@chatroom", "b", "")], "chat string, username string, nick string")
    got = {r.real_sender_id: (r.sender, r.is_self) for r in chats.with_display(df, people, nicks, "me").collect()}
    assert got == {1: ("我", True), 2: ("系统", False), 3: ("未知(3)", False), 4: ("Ally", False), 5: ("b", False), 6: ("Alice", False)}


def test_json_documents_and_csv_headers(spark, tmp_path):
    import json

    df = frame(spark, [("a", 0, 0, 1, 60, "x", False, "text", "A,\"q\""), ("a", 0, 0, 2, 90, "y", True, "system", "B"), ("b", 0, 0, 3, 1, "z", True, "text", None)], ", sender string, is_self boolean, kind string, text string")
    lines = {}
    for r in sorted(render.export_json(df).collect(), key=lambda r: (r.part, r.ts or 0)):
        lines.setdefault(r.chat, []).append(r.line)
    docs = {c: json.loads("\n".join(x)) for c, x in lines.items()}
    assert [m["sender"] for m in docs["a"]["messages"]] == ["x", "y"] and docs["b"]["chat"] == {"chat": "b"}
    render.export_messages(df, "csv", f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv" / "chat=a").glob("part-*")))
    assert text.startswith("\ufefftime,sender,is_self,kind,text\n") and text.count("time,sender") == 1 and '"A,""q"""' in text
    assert 'class="sys"' in render.rendered(df, "html").filter("local_id = 2").first().line
    items = spark.createDataFrame([("a", 0, 1, [0], 1, "s", "one"), ("a", 0, 1, [0, 0], 2, "", "two")], "chat string, db int, local_id long, path array<int>, depth int, sender string, text string")
    assert render.with_bundles(df, items).filter("local_id = 1").first().text == 'A,"q"\n  s: one\n    two'


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "chat string, db int, dbr int, local_id long, ts long" + extra)


def test_paging_reassembles_the_whole(spark):
    rows = [("a", 0, 0, i, 100 + i // 3) for i in range(20)]
    df, got, cursor = frame(spark, rows), [], None
    for _ in range(10):
        part = messages.page(df, 3, before=cursor).orderBy("ts", "dbr", "local_id").collect()
        if not part:
            break
        got = [r.local_id for r in part] + got
        cursor = F.struct(F.lit(part[0].ts).alias("ts"), F.lit(part[0].dbr).alias("dbr"), F.lit(part[0].local_id).cast("long").alias("local_id"))
    assert got == list(range(20))


def test_as_of_prefers_the_past(spark):
    df = frame(spark, [("a", 0, 0, 1, 10), ("a", 0, 0, 2, 20), ("b", 0, 0, 3, 50)])
    probes = frame(spark, [("a", 0, 0, 91, 20), ("a", 0, 0, 92, 5), ("b", 0, 0, 93, 60), ("c", 0, 0, 94, 1)])
    got = {r.local_id: (r.target_id, r.fell_forward) for r in messages.as_of(probes, df).collect()}
    assert got == {91: (2, False), 92: (1, True), 93: (3, False), 94: (None, True)}


def test_tail_keeps_ties_and_drops_late_rows(spark):
    old = frame(spark, [("a", 0, 0, 1, 10), ("a", 0, 0, 2, 20), ("a", 0, 0, 3, 20)])
    state = incremental.tail_state(old)
    assert state.collect()[0].asDict() == {"chat": "a", "last_ts": 20, "n_last": 2}
    now = frame(spark, [("a", 0, 0, 1, 10), ("a", 0, 0, 2, 20), ("a", 0, 0, 3, 20), ("a", 0, 0, 4, 20), ("a", 0, 0, 5, 15), ("a", 0, 0, 6, 30), ("b", 0, 0, 7, 1)])
    assert sorted(r.local_id for r in incremental.select_new(now, state).collect()) == [4, 6, 7]
    assert incremental.select_new(old, state).count() == 0


def test_resolution_ladder(spark):
    names = spark.createDataFrame([(1, "Bob"), (2, "bob"), (3, "Bobby"), (4, "BOB")], "key int, name string")
    asked = spark.createDataFrame([("bob",), ("BOBB",), ("Bo",), ("zz",), ("",)], "pattern string")
    got = {}
    for r in chats.resolve(names, asked).collect():
        got.setdefault(r.pattern, []).append((r.key, r.rank, r.ambiguous))
    assert got["bob"] == [(2, 0, False)] and got["BOBB"] == [(3, 2, False)] and len(got["Bo"]) == 4 and "zz" not in got


def test_short_terms_fold_ascii_only(spark, tmp_path):
    df = frame(spark, [("a", 0, 0, 1, 1, "ÉA tale", "me", "text"), ("a", 0, 0, 2, 2, "éa", "me", "text"), ("a", 0, 0, 3, 3, "ÉATALE", "me", "voice")], ", text string, sender string, kind string")
    find = lambda terms, **k: sorted(r.local_id for r in search.search(df, terms, **k).collect())
    assert find(["éa"]) == [2] and find(["éata"]) == [3] and find(["TALE"], exclude_kinds=["voice"]) == [1]
    posted = search.trigram_postings(df)
    search.write_postings(df, f"file://{tmp_path}/postings")
    stored = search.read_postings(spark, f"file://{tmp_path}/postings", ["tale"])
    assert sorted(map(tuple, stored.collect())) == sorted((r.chat, r.local_id, r.gram) for r in posted.filter("gram in ('tal', 'ale')").collect())
    assert sorted(r.local_id for r in search.trigram_search(df, stored, ["tale"]).collect()) == [1, 3] and search.read_postings(spark, f"file://{tmp_path}/postings", ["ab"]).count() == 0
    assert sorted(r.local_id for r in search.trigram_search(df, posted, ["tale"]).collect()) == [1, 3]


def test_services_are_no_persons(spark):
    rows = [("gh_a", 0, True), ("filehelper", 0, True), ("weixin", 0, True), ("@placeholder_foldgroup", 0, True), ("@x", 0, True), ("wxid_v", 8, False), ("shop", 8, True), ("5@chatroom", 8, False), ("bob", None, False), ("own", 0, True)]
    df = spark.createDataFrame(rows, "u string, v int, want boolean")
    assert df.filter(chats.is_not_a_person(F.col("u"), F.col("v"), ["own"]) != F.col("want")).count() == 0


def test_posts(spark):
    xml = "<p><TimelineObject><id></id><username>u</username><createTime>9</createTime><contentDesc>hi</contentDesc><location poiName='' city='' latitude='0' longitude='0'/><ContentObject><type>1</type><mediaList><media><id>7</id><type>2</type><url>http://x</url><size width='3' height='4'/></media></mediaList></ContentObject></TimelineObject><LocalExtraInfo><nickname>N</nickname><comment_user_list><user_comment><username>b</username><create_time>5</create_time><content>late</content></user_comment><user_comment><username>c</username><create_time>4</create_time><b_deleted>1</b_deleted></user_comment><user_comment><username>d</username><create_time>3</create_time><content></content><imagelist><imageinfo>1</imageinfo></imagelist></user_comment></comment_user_list></LocalExtraInfo></p>"
    raw = spark.createDataFrame([(-3574554073709551615, "x", xml), (2, "y", "<broken"), (3, "z", "<!DOCTYPE a><p/>"), (4, "w", None)], "tid long, user_name string, content string")
    posts = feed.parse_posts(raw)
    p = posts.filter("username = 'u'").first()
    assert (p.id, p.kind, p.location, p.media[0].url, p.media[0].width) == ("14872190000000000001", "image", None, "http://x", 3)
    assert [(c.username, c.text) for c in p.comments] == [("d", "[图片]"), ("b", "late")]
    assert tuple(feed.parse_stats(posts).first()) == (4, 1, 3)
    hidden = spark.createDataFrame([("u",)], "username string")
    assert feed.visible_posts(posts, hidden, "me").filter("username = 'u'").count() == 0 and feed.visible_posts(posts, hidden, "u").filter("username = 'u'").count() == 1


def test_bookmarks(spark):
    xml = "<favitem type='14'><title></title><source><fromusr>a</fromusr></source><datalist><dataitem datatype='1'><datatitle>t</datatitle><datadesc>d</datadesc><dataitemsource><realchatname>b</realchatname></dataitemsource></dataitem></datalist><taglist><tag>work</tag></taglist></favitem>"
    raw = spark.createDataFrame([(1, 0, 5, xml), (2, 5, 6, "<oops")], "local_id long, type int, update_time long, content string")
    marks = bookmarks.parse_bookmarks(raw)
    b = marks.filter("id = 1").first()
    assert (b.kind, b.title, b.desc, b.ts, b.tags) == ("chat_record", "", "d", 5, ["work"]) and marks.filter("kind is null").count() == 1
    tagged = bookmarks.with_tags(marks, spark.createDataFrame([(1, "x"), (1, "work")], "id long, tag string"))
    assert tagged.filter("id = 1").first().tags == ["work", "x"]
    assert bookmarks.visible_bookmarks(marks, spark.createDataFrame([("b",)], "username string"), "me").filter("id = 1").count() == 0
    assert bookmarks.search_bookmarks(tagged, ["D"], kind="14", tag="x").count() == 1


def test_media(spark):
    assert value(spark, media.md5_in(F.lit(b"\x01\xff" + b"a" * 32 + b"\x02"))) == "a" * 32
    assert value(spark, media.md5_in(F.lit(b"a" * 33))) is None
    assert value(spark, media.format_of(F.lit(b"\xff\xd8\xff\xe0"))) == "jpg" and value(spark, media.format_of(F.lit(b"\0\0\0\x18ftypisom"))) == "mp4"
    assert value(spark, media.sticker_info(F.lit('<emoji md5 = "AB" cdnurl="http://x?a=1&amp;b=2" md5="C"/>'))) == {"md5": "AB", "cdnurl": "http://x?a=1&b=2"}
    none = spark.createDataFrame([], "md5 string, failed_at long")
    s = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", ""), ("d", "u")], "md5 string, cdn_url string")
    got = media.sticker_status(s, s.filter("md5 = 'a'"), none, spark.createDataFrame([("b", 1000), ("d", 1)], "md5 string, failed_at long"), 1000 + 3 * 86400 + 400000)
    assert dict(map(tuple, got.collect())) == {"a": "cached", "b": "fetch", "c": "unavailable", "d": "fetch"}


def test_export_writes_each_chat_in_order(spark, tmp_path):
    df = frame(spark, [("a", 0, 0, 2, 90000, "x", True, "text", "B"), ("a", 0, 0, 1, 60, "x<", False, "text", "A"), ("b", 0, 0, 3, 70, "y", True, "text", "C,D")], ", sender string, is_self boolean, kind string, text string")
    for fmt in render.FORMATS:
        render.export_messages(df, fmt, f"{tmp_path}/{fmt}")
    lines = [p.read_text() for p in (tmp_path / "txt" / "chat=a").glob("part-*")]
    assert lines == ["[1970-01-01 00:01:00] x<: A\n[1970-01-02 01:00:00] x: B\n"]
    assert "## 1970-01-02" in "".join(p.read_text() for p in (tmp_path / "md" / "chat=a").glob("part-*"))
    assert "x&lt;" in "".join(p.read_text() for p in (tmp_path / "html" / "chat=a").glob("part-*"))
    with pytest.raises(ValueError):
        render.export_messages(df, "html", f"{tmp_path}/html", mode="append")


def test_document_digests_hold_no_whole_document(spark):
    import hashlib

    rows = [(c, ts, 0, i, "s", False, "text", t) for c in ("b", None, "a") for i, (ts, t) in enumerate([(5, "é"), (3, None), (5, "x\ny"), (1, ""), (5, "z")])] + [("d", 1, 0, 1, "s", False, "text", None)]
    df = spark.createDataFrame(rows, "chat string, ts long, dbr int, local_id long, sender string, is_self boolean, kind string, text string").repartition(3)
    lines = {}
    for r in sorted(render.rendered(df, "txt").collect(), key=lambda r: (r.ts, r.dbr, r.local_id)):
        lines.setdefault(r.chat, []).append(r.line)
    want = {c: (len(x), hashlib.md5("\n".join(t for t in x if t is not None).encode()).hexdigest()) for c, x in lines.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        docs = render.documents(df, "txt")
        assert {r.chat: (r.n, r.digest) for r in docs.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in docs._jdf.queryExecution().toString()
    assert render.documents(df.filter("false"), "txt").count() == 0


def test_tail_exports_a_chat_that_lands_later(spark, tmp_path):
    schema = "chat string, db int, local_id long, ts long, kind string, text string"
    land, out, check = (f"file://{tmp_path}/{x}" for x in ("land", "out", "check"))
    one = [("a", 0, 1, 100_000_000, "text", "x")]
    two = [("c", 0, 1, 5, "text", "old"), ("c", 0, 1, 5, "text", "old"), ("c", 1, 1, 50_000_000, "text", "newer"), ("a", 0, 2, 7, "text", "late"), ("a", 0, 1, 100_000_001, "text", "x")]
    three = [*two, ("c", 1, 2, 50_000_001, "text", "last"), ("e", 0, 1, 1, "text", "first")]
    for rows in (one, two, three):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        query = tail.export_tail(tail.landed(spark, land, schema), out, check)
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted((r.chat, r.db, r.local_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 1), ("c", 0, 1), ("c", 1, 1), ("c", 1, 2), ("e", 0, 1)]


def test_streamed_tail_equals_one_batch(spark, tmp_path):
    schema = "chat string, db int, local_id long, ts long, kind string, text string"
    land, out, check = (f"file://{tmp_path}/{x}" for x in ("land", "out", "check"))
    one = [("a", 0, 1, 10, "text", "x"), ("a", 0, 2, 20, "text", "y"), ("b", 0, 3, 5, "text", "z")]
    two = [("a", 0, 2, 20, "text", "y"), ("a", 0, 4, 20, "text", "w"), ("a", 0, 5, 15, "text", "late"), ("b", 0, 6, 7, "text", "v")]
    for rows in (one, two, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        query = tail.export_tail(tail.landed(spark, land, schema), out, check, late="100 days")
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted((r.chat, r.local_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("a", 2), ("a", 4), ("b", 3), ("b", 6)]
