"""From SQLite files and first bytes to located media; semantics that an archive of its own shows."""

import sqlite3
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from chatlake.functions import decoders
from chatlake.functions.scalars import unescape_entities
from chatlake.operators import attach, bookmarks, chats, enrich, feed, jobs, media, messages, search
from chatlake.sources import archive, landed


def make(path, statements):
    with sqlite3.connect(path) as db:
        for sql, rows in statements:
            db.executemany(sql, rows) if rows is not None else db.execute(sql)
    db.close()


def test_voices_and_images_from_files_to_records(spark, tmp_path):
    table = ("CREATE TABLE VoiceInfo (chat_name_id INTEGER, create_time INTEGER, local_id INTEGER, svr_id INTEGER, voice_data BLOB, data_index TEXT)", None)
    for n, names, rows in ((0, ["x", "ann"], [(2, 100, 1, 77, b"late", "10"), (2, 100, 1, 77, b"early", "9"), (2, 5, 9, 0, b"", "0")]), (3, ["ann"], [(1, 100, 1, 77, b"other store", "0"), (1, 200, 1, 0, b"by time", "0")])):
        make(tmp_path / f"media_{n}.db", [table, ("INSERT INTO VoiceInfo VALUES (?,?,?,?,?,?)", rows), ("CREATE TABLE Name2Id (user_name TEXT)", None), ("INSERT INTO Name2Id VALUES (?)", [(x,) for x in names])])
    md5 = "0123456789abcdef" * 2
    make(
        tmp_path / "message_resource.db",
        [("CREATE TABLE MessageResourceInfo (chat_id INTEGER, message_local_id INTEGER, message_local_type INTEGER, message_create_time INTEGER, packed_info BLOB)", None), ("INSERT INTO MessageResourceInfo VALUES (?,?,?,?,?)", [(1, 4, 3, 300, b"\x0a " + md5.encode()), (1, 4, 43, 301, md5.encode()), (1, 5, 3, 300, b"none")]), ("CREATE TABLE ChatName2Id (user_name TEXT)", None), ("INSERT INTO ChatName2Id VALUES ('ann')", None)],
    )
    rows = spark.createDataFrame([("ann", 0, 1, 77, 100, None), ("ann", 1, 1, 0, 200, None), ("ann", 0, 4, 5, 300, None), ("ann", 1, 4, 6, 300, None), ("bob", 0, 1, 77, 100, None)], "chat string, db int, local_id long, server_id long, ts long, md5 string")
    hashed = attach.with_resource_md5(rows, archive.image_hashes(spark, str(tmp_path)))
    files = spark.createDataFrame([("ann", md5, "1970-01", "", "p"), ("ann", md5, "1970-01", "_t", "t")], "chat string, md5 string, month string, variant string, path string")
    found = attach.with_media(rows.drop("md5"), images=media.locate_images(hashed.filter("md5 is not null"), files), voices=media.locate_voices(rows, archive.voices(spark, str(tmp_path))))
    got = {(r.chat, r.db, r.local_id): (r.image_path, bytes(r.voice) if r.voice else None, r.voice_stem) for r in found.collect()}
    assert got == {("ann", 0, 1): (None, b"earlylate", "77"), ("ann", 1, 1): (None, b"by time", "200_1"), ("ann", 0, 4): ("p", None, None), ("ann", 1, 4): ("p", None, None), ("bob", 0, 1): (None, None, None)}


def test_stickers_and_files_by_digest(spark, tmp_path):
    make(tmp_path / "emoticon.db", [("CREATE TABLE kNonStoreEmoticonTable (md5 TEXT, cdn_url TEXT, thumb_url TEXT)", None), ("INSERT INTO kNonStoreEmoticonTable VALUES (?,?,?)", [("AB" * 16, "http://c", None), ("", "x", "y"), (None, "x", "y")])])
    assert [(r.md5, r.cdn_url, r.thumb_url, r.extern_url) for r in archive.stickers(spark, str(tmp_path)).collect()] == [("ab" * 16, "http://c", "", "")]
    copies = spark.createDataFrame([("A", "older", 9, "o"), ("a", "recent", 1, "r1"), ("a", "recent", 5, "r5"), ("b", "own", 1, "w"), ("b", "recent", 7, "r7"), ("c", "elsewhere", 1, "z")], "md5 string, place string, mtime long, path string")
    assert dict(map(tuple, archive.sticker_copies(copies).collect())) == {"a": "r5", "b": "w"}
    for sub in ("data", "thumb", "other"):
        (tmp_path / sub / "x").mkdir(parents=True)
        (tmp_path / sub / "x" / "f").write_bytes(b"hello")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "f").load(str(tmp_path))
    files = archive.files_by_digest(binary)
    assert sorted((r.md5, r["sub"]) for r in files.collect()) == [("5d41402abc4b2a76b9719d911017c592", "data"), ("5d41402abc4b2a76b9719d911017c592", "thumb")]
    items = spark.createDataFrame([("1", 0, "5D41402ABC4B2A76B9719D911017C592", None)], "id string, pos int, fullmd5 string, thumbmd5 string")
    assert attach.bookmark_files(items, files).first().data.endswith("/data/x/f")


def test_compressed_bookmarks_and_counts_of_one_reading(spark, tmp_path):
    xml = "<favitem type='5'><title>T é</title></favitem>"
    rows = [(1, 0, 5, 60, zstandard.compress(xml.encode())), (2, 0, 5, 61, xml), (3, 0, 5, 62, "<favitem"), (4, 0, 5, 63, None)]
    make(tmp_path / "favorite.db", [("CREATE TABLE fav_db_item (local_id INTEGER, server_id INTEGER, type INTEGER, update_time INTEGER, content)", None), ("INSERT INTO fav_db_item VALUES (?,?,?,?,?)", rows)])
    spark.dataSource.register(landed.LandedTable)
    marks, seen = bookmarks.load_bookmarks(landed.landed(spark, str(tmp_path), "favorite.db", **landed.BOOKMARKS))
    assert sorted((r.id, r.kind, r.title) for r in marks.collect()) == [(1, "link", "T é"), (2, "link", "T é")]
    assert seen.get == {"rows": 4, "parsed": 2, "failed": 2}
    post = "<p><TimelineObject><id>{0}</id><username>u</username><createTime>{0}</createTime><ContentObject><type>2</type></ContentObject></TimelineObject></p>"
    posts, seen = feed.load_posts(spark.createDataFrame([(i, "u", post.format(i)) for i in (5, 6, 7)] + [(8, "u", "<p")], "tid long, user_name string, content string"), since=6, until=7)
    assert [r.id for r in posts.collect()] == ["6"] and seen.get == {"rows": 4, "parsed": 3, "failed": 1}
    jobs.log_reading(spark, seen, f"file://{tmp_path}/log", "posts", "2024-05-01")
    (line,) = jobs.read_log(spark, f"file://{tmp_path}/log", "job string, time string, status string, rows long, parsed long, failed long").collect()
    assert tuple(line) == ("posts", "2024-05-01", "partial", 4, 3, 1)


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


MOVIE = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500) + b"\0" * 8)
WAVE = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
FILES = [
    (box(b"ftyp", b"isom") + box(b"free", b"mvhd" + b"\x01" * 40) + box(b"moov", box(b"udta", MOVIE[:20]) + MOVIE), ("mp4", 2.5)),
    (box(b"ftyp", b"M4A ") + struct.pack(">I4sQ", 1, b"mdat", 24) + b"moovmvhd" + box(b"moov", MOVIE), ("m4a", 2.5)),
    (box(b"ftyp", b"isom") + box(b"mdat", MOVIE), ("mp4", None)),
    (b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", 13) + b"data\xff\xff\xff\xffdata1\0" + WAVE + b"data" + struct.pack("<I", 8000), ("wav", 0.5)),
    (b"RIFF\0\0\0\0WEBPVP8 ", ("webp", None)), (b"\x02#!SILK_V3\x01\0a\x01\0b", ("silk", 0.04)), (b"#!AMR\n", ("amr", None)), (b"\xff\xd8\xff\xe0", ("jpg", None)), (b"", ("bin", None)), (b"\0\0\0\x04moov", ("mp4", None)), (None, (None, None)),
]


def test_media_profile_walks_boxes(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(FILES)], "i int, c binary")
    got = {r.i: (r.p.fmt, r.p.seconds) for r in rows.select("i", attach.media_profile(F.col("c")).alias("p")).collect()}
    assert got == {i: pytest.approx(want) if want[1] else want for i, (_, want) in enumerate(FILES)}
    assert decoders._profile(FILES[0][0])[1] == 2.5


def nested(depth):
    inner = f"<recordinfo><datalist><dataitem datatype='1'><datadesc>deep{depth}</datadesc></dataitem></datalist></recordinfo>"
    for d in range(depth - 1, 0, -1):
        body = inner if d % 2 else inner.replace("&", "&amp;").replace("<", "&lt;")  # as elements and as text
        inner = f"<recordinfo><datalist><dataitem datatype='1'><datadesc>d{d}</datadesc></dataitem><dataitem datatype='17'><datatitle>t{d}</datatitle><recordxml>{body}</recordxml></dataitem></datalist></recordinfo>"
    return inner


def test_bundles_of_any_depth(spark):
    content = "<msg><appmsg><type>19</type><recorditem><![CDATA[" + nested(9) + "]]></recorditem></appmsg></msg>"
    rows = spark.createDataFrame([(1, 49, content), (2, 49, content.replace("<datalist>", "<datalist", 1)), (3, 49, "<msg><appmsg><recorditem><![CDATA[<!DOCTYPE x><recordinfo/>]]></recorditem></appmsg></msg>")], "local_id long, base long, content string")
    got = [(r.depth, r.path, r.text) for r in enrich.bundle_items(rows).collect()]
    assert len(got) == 17 and (9, [1] * 8 + [0], "deep9") in got and (3, [1, 1, 1], "[聊天记录] t3") in got


CALLS = [
    ("Call canceled by caller", "cancelled"), ("Line busy. Call not received.", "busy"), ("Call not answered", "missed"), ("对方无应答", "missed"), ("对方已拒绝", "declined"), ("Declined on other device", "declined_elsewhere"),
    ("已在其他设备拒绝", "declined_elsewhere"), ("Already answered elsewhere", "answered_elsewhere"), ("已在其他设备接听", "answered_elsewhere"), ("Call answered", "unknown"), ("Something new", "unknown"), ("通话时长 01:00:05", "completed"),
]


def test_calls_cards_and_entities(spark):
    rows = spark.createDataFrame([(i, 50, f"<voipmsg><VoIPBubbleMsg><msg>{m}</msg><room_type>1</room_type></VoIPBubbleMsg></voipmsg>") for i, (m, _) in enumerate(CALLS)], "local_id long, local_type long, content string")
    got = {r.local_id: r.status for r in enrich.enrich_messages(rows).select("local_id", F.get_json_object("extra", "$.status").alias("status")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(CALLS)}
    cards = [(1, 66, '<msg nickname="Wu" username="25984@openim"/>'), (2, 66, "<msg><nickname>no</nickname></msg>"), (3, 42, '<msg username="u"/>'), (4, 66, "plain")]
    found = {r.local_id: (r.kind, r.text) for r in enrich.enrich_messages(spark.createDataFrame(cards, "local_id long, local_type long, content string")).collect()}
    assert found == {1: ("card", "[企业微信名片] Wu"), 2: ("other", "[消息类型:66]"), 3: ("card", "[名片]"), 4: ("other", "plain")}
    texts = [("a &lt;b&gt; &amp;amp; &#65;&#x4e2d; &quot;&apos;", "a <b> &amp; A中 \"'"), ("&amp;#65;", "&#65;"), ("&#1114112; &#xD800; &nope; & ;", "&#1114112; &#xD800; &nope; & ;"), ("", ""), (None, None), ("😀&#128512;", "😀😀")]
    df = spark.createDataFrame(texts, "s string, want string")
    assert [(r.got, r.want) for r in df.select(unescape_entities(F.col("s")).alias("got"), "want").collect()] == [(w, w) for _, w in texts]
    info = media.sticker_info(F.lit('<emoji md5=" ABCDEF0123456789ABCDEF0123456789 " cdnurl="http://x?a&#61;1"/>'))
    r = spark.range(1).select(info["cdnurl"].alias("u"), media.sticker_md5(info).alias("m"), media.sticker_md5(media.sticker_info(F.lit('<emoji md5="zz"/>'))).alias("none")).first()
    assert (r.u, r.m, r.none) == ("http://x?a=1", "abcdef0123456789abcdef0123456789", None)


def test_names_by_part_without_a_nested_loop(spark, capsys):
    names = spark.createDataFrame([(1, "Alice R"), (2, "alice"), (3, "Bob"), (4, "阿里"), (12, "x"), (5, "ab"), (6, "A%b")], "key int, name string")
    asked = spark.createDataFrame([(p,) for p in ("alice", "ALICE", "li", "b", "阿", "12", "", "zzz", "a%B", "bob")], "pattern string")
    low = lambda s: s.lower()
    want = set()
    for k, n in ((r.key, r.name) for r in names.collect()):
        for p in (r.pattern for r in asked.collect()):
            ranks = [0 if t == p else 1 if low(t) == low(p) else 2 for t in (n, str(k)) if p and low(p) in low(t)]
            if ranks:
                want.add((p, k, n, min(ranks)))
    found = chats.ranked_matches(names, asked)
    assert {tuple(r) for r in found.collect()} == want
    for df in (found, chats.resolve(names, asked)):
        df.explain()
        plan = capsys.readouterr().out
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contacts_that_repeat_and_candidates(spark):
    rows = spark.createDataFrame([("a", "a", 1)], "chat string, sender_user string, real_sender_id long")
    people = spark.createDataFrame([("a", "Stranger A", "stranger"), ("a", "Ann", "contact")], "username string, display string, source string")
    nicks = spark.createDataFrame([], "chat string, username string, nick string")
    assert [r.sender for r in chats.with_display(rows, people, nicks, "me").collect()] == ["Ann"]
    posts = spark.createDataFrame([("u", str(i), "Uma") for i in range(3)] + [("v", "9", "Uma"), ("w", "8", "uma x")], "username string, id string, nickname string")
    assert [tuple(r) for r in jobs.author_candidates(posts, "Uma", "me").collect()] == [("u", 3, 0), ("v", 1, 0)]
    assert [tuple(r) for r in jobs.author_candidates(posts, "um", "me", 2).collect()] == [("u", 3, 2), ("v", 1, 2)]
    page = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "chat string, rn int")
    assert sorted(map(tuple, messages.newest_first(page).collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)] and messages.with_total(posts, page).first() == (5, 4)


def test_postings_of_two_shards_and_a_repeated_append(spark, tmp_path):
    rows = [("a", 0, 0, 1, 1, "a tale told"), ("a", 1, -1, 1, 2, "told a tale"), ("a", 1, -1, 2, 3, "tales"), ("b", 0, 0, 1, 4, "ta le")]
    df = spark.createDataFrame([(*r, "text", "s") for r in rows], "chat string, db int, dbr int, local_id long, ts long, text string, kind string, sender string")
    path = f"file://{tmp_path}/postings"
    search.write_postings(df, path)
    search.write_postings(df, path, mode="append")
    for terms in (["tale"], ["tale", "told"]):
        want = sorted((r.chat, r.db, r.local_id) for r in search.search(df, terms).collect())
        for postings in (search.read_postings(spark, path, terms, shards=True), search.read_postings(spark, path, terms), search.trigram_postings(df)):
            assert sorted((r.chat, r.db, r.local_id) for r in search.trigram_search(df, postings, terms).collect()) == want
    assert len(want) == 2
