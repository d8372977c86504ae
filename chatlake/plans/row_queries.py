"""Queries of single rows' work: decoding, types, times, hashes, senders, media headers; and of what readings count."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import decoders
from chatlake.functions.scalars import parse_time
from chatlake.operators import attach, enrich, feed, jobs, media, messages, render_rich
from chatlake.plans.archive_queries import _posts
from chatlake.plans.chat_queries import EV
from chatlake.session import table
from chatlake.sources.tables import event_messages


def _str(c):
    return F.col(c).cast("string")


@cache
def _writer():
    import zstandard

    return zstandard.ZstdCompressor()


@F.udf(T.BinaryType(), useArrow=False)
def _packed(text: str | None) -> bytes | None:
    return None if text is None else _writer().compress(text.encode())


def _stored(spark, d):
    """Texts as an archive stores them: every second one compressed, some frames broken."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    odd = F.col("doc_id") % 2 == 1
    broken = F.substring(_packed("text"), 1, 9)
    return docs.withColumns({"ct": F.when(odd, 4).otherwise(0), "content": F.when(odd & (F.col("doc_id") % 7 == 0), broken).when(odd, _packed("text")).otherwise(F.col("text").cast("binary"))})


def decoded_content(spark, d):
    rows = _stored(spark, d).select("doc_id", decoders.decode_content(F.col("content"), F.col("ct")).alias("text"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def decoded_blobs(spark, d):
    rows = _stored(spark, d).select("doc_id", decoders.decode_blob(F.col("content")).alias("text"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def split_types(spark, d):
    base, sub = enrich.split_type(F.col("o_orderkey") * 7919 % 12000 + F.shiftleft(F.col("o_custkey"), 32))
    return table(spark, d, "orders").select("o_orderkey", base.alias("base"), sub.alias("sub"))


def time_literals(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T10:20:30"))).when(k == 2, F.concat(F.replace(day, F.lit("-"), F.lit("/")), F.lit(" 01:02:03"))).when(k == 3, F.concat(_str("o_orderkey"), F.lit("h")))
        .when(k == 4, F.concat(F.lit("17000"), F.lpad(F.right(_str("o_orderkey"), F.lit(5)), 5, "0"))).otherwise(F.concat(day, F.lit(" no time")))
    )
    now = F.lit(1_700_000_000)
    return table(spark, d, "orders").select("o_orderkey", parse_time(text, now).alias("since"), parse_time(text, now, end=True).alias("until"))


def hashes_in_bytes(spark, d):
    """A hash that stands alone among other bytes; one in capitals, or glued to another digit, doesn't count."""
    md5 = F.md5(_str("page_id").cast("binary"))
    glue = F.when(F.col("page_id") % 3 == 0, "f").otherwise("\u0001")
    body = F.concat(F.lit("\n "), F.upper(md5), F.lit("!"), F.when(F.col("page_id") % 5 == 0, "").otherwise(md5), glue, F.lit("x"))
    return table(spark, d, "pages").select("page_id", media.md5_in(body.cast("binary")).alias("md5"))


def senders_in_xml(spark, d):
    name, k = F.concat(F.lit("u"), _str("o_custkey")), F.col("o_orderkey") % 4
    xml = F.when(k == 0, F.concat(F.lit('<img fromusername = "'), name, F.lit('"/>'))).when(k == 1, F.concat(F.lit("<m><fromusername><![CDATA["), name, F.lit("]]></fromusername></m>"))).when(k == 2, F.concat(F.lit('<m tofromusername="'), name, F.lit('"/>'))).otherwise(name)
    return table(spark, d, "orders").select("o_orderkey", enrich.sender_in_xml(xml).alias("sender"))


def decoded_members(spark, d):
    """Member lists as the archive has them, read back in order."""
    part = lambda tag, text: F.concat(F.lit(tag), F.lpad(F.hex(F.length(text)), 2, "0"), F.hex(text))
    inner = F.concat(part("0A", F.concat(F.lit("c"), _str("c_custkey"))), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(part("12", F.col("c_mktsegment"))))
    one = F.concat(F.lit("0A"), F.lpad(F.hex((F.length(inner) / 2).cast("int")), 2, "0"), inner)
    c = table(spark, d, "customer").withColumn("one", one)
    lists = c.groupBy((F.col("c_custkey") % 97).alias("room")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "one"))).alias("x"))
    rooms = lists.select("room", F.unhex(F.array_join(F.transform("x", lambda m: m["one"]), "")).alias("ext_buffer"))
    return decoders.room_members(rooms)


def media_profiles(spark, d):
    """WAV and MP4 files whose payload holds the names of the headers looked for."""
    n = F.col("event_id") * 50
    hex8 = F.lpad(F.hex(n), 8, "0")
    little = F.unhex(F.concat(*[F.substring(hex8, k, 2) for k in (7, 5, 3, 1)]))
    wave = F.concat(F.lit(b"RIFF\0\0\0\0WAVELIST\x08\0\0\0data\xff\xff\xff\xfffmt \x10\0\0\0\x01\0\x01\0\x40\x1f\0\0\x80\x3e\0\0\x02\0\x10\0data"), little)
    film = F.concat(F.lit(b"\0\0\0\x0cftypisom\0\0\0\x10freemvhd\x01\x01\x01\x01\0\0\0\x28moov\0\0\0\x20mvhd\0\0\0\0\0\0\0\0\0\0\0\0\0\0\x03\xe8"), F.unhex(hex8))
    e = table(spark, d, "events")
    p = attach.media_profile(F.when(F.col("event_id") % 3 == 0, wave).when(F.col("event_id") % 3 == 1, film).otherwise(F.lit(b"GIF89a")))
    return e.select("event_id", p.alias("p")).select("event_id", "p.fmt", "p.seconds")


def friends_preferred(spark, d):
    """Of the people that share a nation's name in a pattern, the one friend if there is just one."""
    c = table(spark, d, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 40).cast("string")).alias("pattern"), F.col("c_custkey").alias("key"), F.lit("contact").alias("source"), F.when(F.col("c_custkey") % 50 == 1, 1).otherwise(4).alias("local_type"), F.col("c_name").alias("display"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("p"), (F.col("s_suppkey") % 40).cast("string")).alias("pattern"), (-F.col("s_suppkey")).alias("key"), F.lit("stranger").alias("source"), F.lit(1).alias("local_type"), F.col("s_name").alias("display"))
    return jobs.prefer_friends(c.unionByName(s)).select("pattern", "key")


def author_candidates(spark, d):
    posts = table(spark, d, "documents").select(F.col("source").alias("username"), _str("doc_id").alias("id"), F.concat(F.lit("Name "), F.substring("source", 4, 9)).alias("nickname"))
    return jobs.author_candidates(posts, "name 1", "src3", 8)


def posts_stats(spark, d):
    return feed.parse_stats(_posts(spark, d))


def page_newest_first(spark, d):
    return messages.newest_first(messages.page(event_messages(spark, d), 5)).select("chat", "db", "local_id", "rn")


def page_totals(spark, d):
    ev = event_messages(spark, d)
    return messages.with_total(ev, messages.page(ev, 5))


def _rich(spark, d):
    """Pictures, links, quotes, recordings and texts in turn."""
    ev = event_messages(spark, d).withColumn("id", (F.col("server_id") / 10).cast("long"))
    n, of = _str("id"), lambda k, v: F.when(F.col("id") % 5 == k, v)
    kind = F.element_at(F.array(*map(F.lit, ("image", "link", "quote", "voice", "text"))), (F.col("id") % 5 + 1).cast("int"))
    extra = F.coalesce(of(1, F.to_json(F.struct(F.concat(F.lit("T "), n).alias("title"), F.concat(F.lit("https://e.org/"), n).alias("url")))), of(2, F.to_json(F.struct(F.lit("r").alias("reply"), F.lit("s").alias("sender"), F.concat(F.lit("q"), n).alias("text")))))
    return ev.withColumns({
        "sender": _str("chat"), "is_self": F.col("kind") == "view", "text": F.coalesce(of(0, F.lit("[图片]")), of(3, F.lit("[语音]")), F.concat_ws(" ", "kind", "extra")),
        "seconds": of(3, (F.col("id") % 100).cast("double")), "image_path": of(0, F.concat(F.lit("m/"), n, F.lit(" x.jpg"))), "kind": kind, "extra": extra,
    })


def export_md_rich(spark, d):
    return render_rich.md_lines(_rich(spark, d)).select("chat", "db", "local_id", "line")


def export_html_rich(spark, d):
    return render_rich.html_lines(_rich(spark, d)).select("chat", "db", "local_id", "line")


QUERIES = {f.__name__: f for f in (
    decoded_content, decoded_blobs, split_types, time_literals, hashes_in_bytes, senders_in_xml, decoded_members, media_profiles, friends_preferred, author_candidates, posts_stats, page_newest_first, page_totals, export_md_rich, export_html_rich,
)}

_PAGE = f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts DESC, dbr DESC, local_id DESC) AS rn FROM ev)"
_RICH = f"""WITH {EV}, e AS (SELECT *, server_id // 10 AS id, kind || ' ' || extra AS said, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS clock FROM ev),
      f AS (SELECT *, substr(clock, 1, 10) AS day, coalesce(substr(clock, 1, 10) <> lag(substr(clock, 1, 10)) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS fresh FROM e)"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
ORACLES = {
    "export_md_rich": f"""{_RICH} SELECT chat, db, local_id, CASE WHEN fresh THEN '## ' || day || chr(10) || chr(10) ELSE '' END || '**' || chat || '** ' || substr(clock, 12, 5) || '  ' || CASE id % 5
        WHEN 0 THEN '![[图片]](m/' || id || '%20x.jpg)' WHEN 1 THEN '[链接] [T ' || id || '](https://e.org/' || id || ')' WHEN 2 THEN 'r' WHEN 3 THEN '[语音 ' || (id % 100) || '″]' ELSE replace(said, '<', '&lt;') END || chr(10)
        || CASE WHEN id % 5 = 2 THEN chr(10) || '> s: q' || id || chr(10) ELSE '' END AS line FROM f""",
    "export_html_rich": f"""{_RICH} SELECT chat, db, local_id, CASE WHEN fresh THEN '<div class="day">' || day || '</div>' || chr(10) ELSE '' END || '<div class="msg ' || CASE WHEN kind = 'view' THEN 'self' ELSE 'other' END || '"><b>' || chat || '</b><p>' || CASE id % 5
        WHEN 0 THEN '<img loading="lazy" src="m/' || id || '%20x.jpg" alt="[图片]">' WHEN 1 THEN '[链接] <a href="https://e.org/' || id || '" rel="noopener noreferrer nofollow">T ' || id || '</a>' WHEN 2 THEN 'r<div class="quote">s: q' || id || '</div>'
        WHEN 3 THEN '[语音 ' || (id % 100) || '″]' ELSE {_ESC.format('said')} END || '</p></div>' AS line FROM f""",
    "decoded_content": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 0 THEN md5(text) END AS digest FROM documents",
    "decoded_blobs": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 7 <> 0 THEN md5(text) END AS digest FROM documents",
    "split_types": """WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey * 7919 % 12000 AS b FROM orders)
      SELECT o_orderkey, CASE WHEN b > 255 AND b NOT IN (10000, 10002, 11000) THEN b & 255 ELSE b END AS base, o_custkey AS sub FROM t""",
    "time_literals": """WITH o AS (SELECT *, o_orderkey % 6 AS k, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS day FROM orders)
      SELECT o_orderkey, CASE k WHEN 0 THEN day WHEN 1 THEN day + 37230 WHEN 2 THEN day + 3723 WHEN 3 THEN 1700000000 - o_orderkey * 3600 WHEN 4 THEN 1700000000 + o_orderkey % 100000 END AS since,
        CASE k WHEN 0 THEN day + 86399 WHEN 1 THEN day + 37230 WHEN 2 THEN day + 3723 WHEN 3 THEN 1700000000 - o_orderkey * 3600 WHEN 4 THEN 1700000000 + o_orderkey % 100000 END AS until FROM o""",
    "hashes_in_bytes": "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN md5(CAST(page_id AS VARCHAR)) END AS md5 FROM pages",
    "senders_in_xml": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'u' || o_custkey END AS sender FROM orders",
    "decoded_members": "SELECT c_custkey % 97 AS room, CAST(row_number() OVER (PARTITION BY c_custkey % 97 ORDER BY c_custkey) - 1 AS INT) AS pos, 'c' || c_custkey AS member, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS group_nick FROM customer",
    "media_profiles": "SELECT event_id, ['wav', 'mp4', 'gif'][event_id % 3 + 1] AS fmt, CASE event_id % 3 WHEN 0 THEN event_id * 50 / 16000.0::DOUBLE WHEN 1 THEN event_id * 50 / 1000.0::DOUBLE END AS seconds FROM events",
    "friends_preferred": """WITH p AS (SELECT 'p' || (c_custkey % 40) AS pattern, c_custkey AS key, c_custkey % 50 = 1 AS friend FROM customer UNION ALL SELECT 'p' || (s_suppkey % 40), -s_suppkey, false FROM supplier),
      n AS (SELECT *, count(*) FILTER (friend) OVER (PARTITION BY pattern) AS friends FROM p) SELECT pattern, key FROM n WHERE friends <> 1 OR friend""",
    "author_candidates": """WITH a AS (SELECT source AS username, count(DISTINCT doc_id) AS n, CASE WHEN 'name ' || substr(source, 4, 9) = 'name 1' THEN 1 ELSE 2 END AS rank FROM documents WHERE contains(lower('name ' || substr(source, 4, 9)), 'name 1') GROUP BY source)
      SELECT username, n, rank FROM a WHERE rank = (SELECT min(rank) FROM a) ORDER BY n DESC, username LIMIT 8""",
    "posts_stats": "SELECT count(*) AS rows, count(*) AS parsed, 0::BIGINT AS failed FROM documents",
    "page_newest_first": f"{_PAGE} SELECT chat, db, local_id, rn FROM r WHERE rn <= 5",
    "page_totals": f"{_PAGE} SELECT count(*) AS total, count(*) FILTER (rn <= 5) AS count FROM r",
}
