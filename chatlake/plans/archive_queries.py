"""Enrichment, feed, bookmark, media and export queries: archives that Spark makes of the given tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.scalars import cache_key, escape_html, human_size
from chatlake.operators import bookmarks, enrich, feed, media, render
from chatlake.plans.chat_queries import CV, EV
from chatlake.session import table
from chatlake.sources.tables import conversation_messages, event_messages, seconds


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _app(inner, kind):
    return F.concat(F.lit('<?xml version="1.0"?>\n<msg><appmsg>'), inner, F.lit(f"<type>{kind}</type></appmsg></msg>"))


def enrich_link_roundtrip(spark, d):
    p = table(spark, d, "pages")
    content = _app(F.concat(_tag("title", F.concat(F.lit("Page "), F.col("page_id").cast("string"))), _tag("url", escape_html(F.col("url")))), 5)
    rows = enrich.enrich_messages(p.select("page_id", F.lit(49 | 5 << 32).alias("local_type"), content.alias("content")))
    return rows.select("page_id", "kind", "text", F.get_json_object("extra", "$.url").alias("url"))


def enrich_transfer_roundtrip(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "3").when(F.col("o_orderstatus") == "O", "1").otherwise("4")
    inner = F.concat(F.lit("<title>t</title><wcpayinfo><feedesc>￥"), F.col("o_orderkey").cast("string"), F.lit(".50</feedesc><paysubtype>"), status, F.lit("</paysubtype><pay_memo>"), F.col("o_orderpriority"), F.lit("</pay_memo></wcpayinfo>"))
    rows = enrich.enrich_messages(o.select("o_orderkey", F.lit(49).cast("long").alias("local_type"), _app(inner, 2000).alias("content")))
    return rows.select("o_orderkey", "kind", "text", F.get_json_object("extra", "$.status").alias("status"))


def enrich_call_roundtrip(spark, d):
    e = table(spark, d, "events")
    msg = F.concat(F.lit("Duration: "), F.floor(F.col("event_id") / 60).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    content = F.concat(F.lit("<voipmsg><VoIPBubbleMsg><msg>"), msg, F.lit("</msg><room_type>"), (F.col("event_id") % 2).cast("string"), F.lit("</room_type></VoIPBubbleMsg></voipmsg>"))
    rows = enrich.enrich_messages(e.select("event_id", F.lit(50).cast("long").alias("local_type"), content.alias("content")))
    return rows.select("event_id", "text", F.get_json_object("extra", "$.duration").cast("long").alias("duration"))


def enrich_quote_roundtrip(spark, d):
    c = table(spark, d, "conversations")
    previous = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("q_role"), F.col("text").alias("q_text"))
    ref = F.concat(F.lit("<title>ok</title><refermsg><type>1</type><displayname>"), F.col("q_role"), F.lit("</displayname><content>"), escape_html(F.col("q_text")), F.lit("</content></refermsg>"))
    raw = c.join(previous, ["conv_id", "turn"]).select("conv_id", "turn", F.lit(49 | 57 << 32).alias("local_type"), _app(ref, 57).alias("content"))
    return enrich.enrich_messages(raw).select("conv_id", "turn", "kind", "text")


def _posts(spark, d):
    """A post for each document; its comments are the events with its number as user, newest first in the XML."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds("ts").alias("ts"), "event_type")
    one = F.concat(F.lit("<user_comment><username>u"), F.col("event_id").cast("string"), F.lit("</username><create_time>"), F.col("ts").cast("string"), F.lit("</create_time><b_deleted>"), F.when(F.col("event_type") == "error", "1").otherwise("0"), F.lit("</b_deleted><content>"), F.col("event_type"), F.lit("</content></user_comment>"))
    comments = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", one.alias("x"))), asc=False), lambda s: s["x"]), "").alias("comments"))
    docs = table(spark, d, "documents").join(comments, "doc_id", "left")
    said = escape_html(F.trim(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")))
    content = F.concat(
        F.lit("<SnsDataItem><TimelineObject><id>"), F.col("doc_id").cast("string"), F.lit("</id><username>"), F.col("source"), F.lit("</username><createTime>"), (F.col("n_chars") + 1000).cast("string"),
        F.lit("</createTime><contentDesc>"), said, F.lit("</contentDesc><ContentObject><type>"), F.when(F.col("lang") == "en", "2").otherwise("1"),
        F.lit("</type></ContentObject></TimelineObject><LocalExtraInfo><comment_user_list>"), F.coalesce("comments", F.lit("")), F.lit("</comment_user_list></LocalExtraInfo></SnsDataItem>"),
    )
    return feed.parse_posts(docs.select(F.col("doc_id").alias("tid"), F.col("source").alias("user_name"), F.replace(content, F.lit("SnsDataItem"), F.lit("post")).alias("content")))


def posts_query(spark, d):
    return feed.query_posts(_posts(spark, d), ["the", "and"]).select("id", "username", "ts", "kind")


def posts_comment_order(spark, d):
    each = _posts(spark, d).select("id", F.posexplode("comments").alias("pos", "c"))
    return each.select("id", "pos", F.col("c.username").alias("username"), F.col("c.ts").alias("ts"))


def posts_authors(spark, d):
    return feed.authors(_posts(spark, d)).select("username", "n")


def _bookmarks(spark, d):
    p = table(spark, d, "pages")
    number = F.col("page_id").cast("string")
    content = F.concat(
        F.lit('<favitem type="5"><title>Page '), number, F.lit("</title><source><fromusr>host"), (F.col("page_id") % 5).cast("string"), F.lit("</fromusr></source><weburlitem><clean_url>"), escape_html(F.col("url")),
        F.lit("</clean_url></weburlitem><taglist><tag>even"), (F.col("page_id") % 2).cast("string"), F.lit("</tag></taglist></favitem>"),
    )
    return bookmarks.parse_bookmarks(p.select(F.col("page_id").alias("local_id"), F.lit(5).alias("type"), (F.col("page_id") * 60).alias("update_time"), content.alias("content")))


def favorites_search(spark, d):
    return bookmarks.search_bookmarks(_bookmarks(spark, d), ["example.net", "page"], kind="link", since=600).select("id", "ts", "title", "url")


def favorites_tags(spark, d):
    bound = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("tag"))
    return bookmarks.with_tags(_bookmarks(spark, d), bound).select("id", F.array_join("tags", ",").alias("tags"))


def favorites_visible(spark, d):
    hidden = table(spark, d, "region").select(F.concat(F.lit("host"), F.col("r_regionkey").cast("string")).alias("username")).filter("username in ('host1', 'host3')")
    return bookmarks.visible_bookmarks(_bookmarks(spark, d), hidden, "host3").select("id")


def _media_files(spark, d):
    """Three variants in two months for each vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id"), F.md5(F.col("vec_id").cast("string").cast("binary")).alias("md5"), (F.col("vec_id") % 10).alias("chat"))
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(x).alias("variant")) for m in ("2024-01", "2023-06") for x in media.VARIANTS]))
    each = v.select("*", kinds.alias("k")).filter((F.col("vec_id") % 3 != 0) | (F.col("k.variant") == "_t")).filter((F.col("vec_id") % 4 != 0) | (F.col("k.month") == "2023-06"))
    return each.select("chat", "md5", F.col("k.month").alias("month"), F.col("k.variant").alias("variant"), F.concat_ws("/", F.col("chat").cast("string"), F.col("k.month"), F.concat("md5", "k.variant")).alias("path"))


def media_locate(spark, d):
    m = table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("chat"), F.col("vec_id").alias("local_id"), F.lit(1704500000).cast("long").alias("ts"), F.md5(F.col("vec_id").cast("string").cast("binary")).alias("md5"))
    return media.locate_images(m, _media_files(spark, d))


def media_newest_copy(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"))
    return media.newest_copies(f)


def feed_media(spark, d):
    m = table(spark, d, "embeddings").select((F.col("vec_id") % 10).cast("string").alias("post_id"), F.col("vec_id").cast("string").alias("media_id"))
    kept = m.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(6)))).filter("(cast(media_id as int) + v) % 3 <> 0")
    files = kept.select(cache_key(F.col("post_id"), F.col("media_id"), F.col("v").cast("string")).alias("key"), F.lit(0).alias("mtime"), F.concat_ws("_", "media_id", F.col("v").cast("string")).alias("path"))
    return media.locate_feed_media(m, files)


def voice_two_stage(spark, d):
    ev = event_messages(spark, d).filter("kind = 'click'").withColumn("server_id", F.when(F.col("local_id") % 3 == 0, F.lit(0)).otherwise(F.col("server_id")).cast("long"))
    part = F.explode(F.array(F.lit("10"), F.lit("9"), F.lit("x"))).alias("data_index")
    blobs = ev.filter("local_id % 5 <> 0").select(F.col("db").alias("store"), "chat", "server_id", "ts", "local_id", part).withColumn("data", F.concat_ws(":", F.col("local_id").cast("string"), "data_index").cast("binary"))
    return media.locate_voices(ev, blobs).groupBy("chat", "local_id", F.col("voice").cast("string").alias("voice")).agg(F.count(F.lit(1)).alias("n"))


def sticker_coverage(spark, d):
    e = table(spark, d, "events")
    url = F.when(F.col("event_type") == "view", F.concat(F.lit("http://s/"), F.col("user_id").cast("string"))).otherwise("")
    content = F.concat(F.lit('<emoji md5="'), F.md5((F.col("user_id") % 60).cast("string").cast("binary")), F.lit('" cdnurl = "'), url, F.lit('" thumburl="'), F.when(F.col("user_id") % 60 < 20, "t").otherwise(""), F.lit('"/>'))
    x = e.withColumn("a", media.sticker_info(content))
    return media.coverage(x.select(F.col("a")["md5"].alias("md5"), F.col("a")["cdnurl"].alias("cdn_url"), F.col("a")["thumburl"].alias("thumb_url")))


def _export(spark, d):
    return conversation_messages(spark, d).withColumn("ts", F.col("ts") * 3600 + F.col("chat") + 1700000000)


def export_txt(spark, d):
    return render.rendered(_export(spark, d), "txt").select("chat", "local_id", "line")


def export_csv_rows(spark, d):
    ev = event_messages(spark, d).withColumns({"sender": F.col("chat").cast("string"), "is_self": F.col("kind") == "view", "text": F.col("extra")})
    return render.rendered(ev, "csv").select("chat", "db", "local_id", "line")


def export_html(spark, d):
    return render.rendered(_export(spark, d), "html").select("chat", "local_id", F.md5(F.col("line").cast("binary")).alias("digest"))


def export_documents(spark, d):
    return render.documents(_export(spark, d), "txt")


def size_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", human_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("label"))


QUERIES = {f.__name__: f for f in (
    enrich_link_roundtrip, enrich_transfer_roundtrip, enrich_call_roundtrip, enrich_quote_roundtrip, posts_query, posts_comment_order, posts_authors, favorites_search,
    favorites_tags, favorites_visible, media_locate, media_newest_copy, feed_media, voice_two_stage, sticker_coverage, export_txt, export_csv_rows, export_html, export_documents, size_labels,
)}

_CLOCK = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_X = f"{CV}, x AS (SELECT chat, dbr, local_id, ts * 3600 + chat + 1700000000 AS ts, sender, is_self, kind, text FROM cv), y AS (SELECT *, {_CLOCK.format('ts')} AS clock FROM x)"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLES = {
    "enrich_link_roundtrip": "SELECT page_id, 'link' AS kind, '[链接] Page ' || page_id || ' ' || url AS text, url FROM pages",
    "enrich_transfer_roundtrip": """SELECT o_orderkey, 'transfer' AS kind, '[转账] ¥' || o_orderkey || '.50' || CASE o_orderstatus WHEN 'F' THEN ' 已收款' WHEN 'O' THEN '' ELSE ' 已退还' END || ' · ' || o_orderpriority AS text,
      CASE o_orderstatus WHEN 'F' THEN 'received' WHEN 'O' THEN 'sent' ELSE 'refunded' END AS status FROM orders""",
    "enrich_call_roundtrip": """SELECT event_id, CASE event_id % 2 WHEN 0 THEN '[视频通话]' ELSE '[语音通话]' END || ' 通话时长 ' || (event_id // 60) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS text,
      event_id AS duration FROM events""",
    "enrich_quote_roundtrip": rf"""WITH q AS (SELECT c.conv_id, c.turn, p.role, trim(regexp_replace(p.text, '\s+', ' ', 'g')) AS s FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1)
      SELECT conv_id, turn, 'quote' AS kind, 'ok [引用 ' || role || ': ' || CASE WHEN length(s) > 50 THEN rtrim(substr(s, 1, 50)) || '…' ELSE s END || ']' AS text FROM q""",
    "posts_query": """WITH p AS (SELECT *, text || chr(10) || coalesce((SELECT string_agg(event_type, chr(10)) FROM events WHERE user_id = doc_id AND event_type <> 'error'), '') AS hay FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS id, source AS username, n_chars + 1000 AS ts, CASE WHEN lang = 'en' THEN 'text' ELSE 'image' END AS kind FROM p
      WHERE contains(lower(hay), 'the') AND contains(lower(hay), 'and')""",
    "posts_comment_order": """WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type FROM events JOIN documents ON user_id = doc_id WHERE event_type <> 'error')
      SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id DESC) - 1 AS pos, 'u' || event_id AS username, ts FROM e""",
    "posts_authors": "SELECT source AS username, count(*) AS n FROM documents GROUP BY source",
    "favorites_search": "SELECT page_id AS id, page_id * 60 AS ts, 'Page ' || page_id AS title, url FROM pages WHERE contains(lower(url), 'example.net') AND page_id >= 10",
    "favorites_tags": "SELECT page_id AS id, 'even' || (page_id % 2) || coalesce((SELECT ',' || string_agg(DISTINCT 'quality' || quality, ',') FROM labels WHERE doc_id = page_id), '') AS tags FROM pages",
    "favorites_visible": "SELECT page_id AS id FROM pages WHERE page_id % 5 <> 1",
    "media_locate": """WITH m AS (SELECT vec_id % 10 AS chat, vec_id AS local_id, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings)
      SELECT chat, local_id, chat || '/' || CASE WHEN local_id % 4 <> 0 THEN '2024-01' ELSE '2023-06' END || '/' || h || CASE WHEN local_id % 3 <> 0 THEN '_h' ELSE '_t' END AS path FROM m""",
    "media_newest_copy": """SELECT l_partkey AS key, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS mtime, l_orderkey || '-' || l_linenumber AS path FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey || '-' || l_linenumber) = 1""",
    "feed_media": """WITH m AS (SELECT vec_id AS i, CAST(vec_id AS VARCHAR) AS media_id, CAST(vec_id % 10 AS VARCHAR) AS post_id FROM embeddings)
      SELECT post_id, media_id, CASE WHEN (i + 2) % 3 <> 0 THEN media_id || '_2' END AS "full", CASE WHEN (i + 1) % 3 <> 0 THEN media_id || '_1' WHEN (i + 6) % 3 <> 0 THEN media_id || '_6' END AS thumb,
        CASE WHEN (i + 3) % 3 <> 0 THEN media_id || '_3' END AS video FROM m""",
    "voice_two_stage": f"""WITH {EV} SELECT chat, local_id, CASE WHEN local_id % 5 <> 0 THEN local_id || ':x' || local_id || ':9' || local_id || ':10' END AS voice, count(*) AS n FROM ev WHERE kind = 'click' GROUP BY ALL""",
    "sticker_coverage": """WITH s AS (SELECT user_id % 60 AS k, count(*) AS n, bool_or(event_type = 'view') AS u FROM events GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) AS stickers, count(*) FILTER (u) AS with_url, count(*) FILTER (k < 20) AS with_thumb FROM s""",
    "export_txt": f"WITH {_X} SELECT chat, local_id, '[' || clock || '] ' || sender || ': ' || text AS line FROM y",
    "export_csv_rows": f"""WITH {EV} SELECT chat, db, local_id, {_CLOCK.format('ts')} || ',' || chat || ',' || CASE WHEN kind = 'view' THEN 1 ELSE 0 END || ',' || kind || ',"' || replace(extra, '"', '""') || '"' AS line FROM ev""",
    "export_html": f"""WITH {_X}, z AS (SELECT *, substr(clock, 1, 10) AS day FROM y), w AS (SELECT *, coalesce(day <> lag(day) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS fresh FROM z)
      SELECT chat, local_id, md5(CASE WHEN fresh THEN '<div class="day">' || day || '</div>' || chr(10) ELSE '' END || CASE WHEN kind = 'system' THEN '<div class="sys">' || {_ESC.format('text')} || '</div>' ELSE '<div class="msg ' || CASE WHEN is_self THEN 'self' ELSE 'other' END || '"><b>' || {_ESC.format('sender')}
        || '</b><p>' || {_ESC.format('text')} || '</p></div>' END) AS digest FROM w""",
    "export_documents": f"WITH {_X} SELECT chat, count(*) AS n, md5(string_agg('[' || clock || '] ' || sender || ': ' || text, chr(10) ORDER BY ts, dbr, local_id)) AS digest FROM y GROUP BY chat",
    "size_labels": """WITH s AS (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)
      SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS label FROM s""",
}
