"""Record queries: raw messages, made of the given tables by Spark, to records of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.scalars import escape_html
from chatlake.operators import enrich, records
from chatlake.session import table
from chatlake.sources.tables import seconds



def _str(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _app(kind, *parts):
    return F.concat(F.lit("<msg><appmsg>"), *parts, F.lit(f"<type>{kind}</type></appmsg></msg>"))


def _enriched(df, key, local_type, content):
    return enrich.enrich_messages(df.select(key, local_type.cast("long").alias("local_type"), content.alias("content")))


def message_records(spark, d):
    """Events as raw messages: rooms with sender prefixes for odd users, chats of two for even ones, shards with dictionaries of their own."""
    e = table(spark, d, "events").withColumn("db", F.pmod("event_id", F.lit(2)).cast("int"))
    group = F.col("user_id") % 2 == 1
    chat = F.when(group, F.concat(_str("user_id"), F.lit("@chatroom"))).otherwise(F.concat(F.lit("u"), _str("user_id")))
    prefix = F.when(group, F.concat(F.lit("u"), _str(F.col("event_id") % 11), F.lit(":\n"))).otherwise("")
    raw = e.select(
        chat.alias("chat"), "db", F.floor(F.col("event_id") / 2).cast("long").alias("local_id"), (F.col("event_id") * 10).alias("server_id"), F.lit(1).cast("long").alias("local_type"), (F.col("event_id") % 3).alias("sort_seq"),
        (F.col("event_id") % 7).alias("real_sender_id"), (F.floor(seconds("ts") / 3600) * 3600).cast("long").alias("create_time"), F.concat(prefix, "props").cast("binary").alias("content"), F.lit(None).cast("int").alias("ct"), F.lit(None).cast("binary").alias("packed_info"),
    )
    k = F.when(F.col("db") == 0, F.col("id")).otherwise(5 - F.col("id"))
    ids = e.select("db", (F.col("event_id") % 7).alias("id")).distinct().filter("id <> 6").withColumn("user_name", F.when(k == 0, "").when(k == 1, "me").otherwise(F.concat(F.lit("u"), _str(k))))
    people = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("u"), _str("c_custkey")).alias("username"), F.col("c_name").alias("display"))
    nicks = e.filter("user_id % 2 = 1").select(chat.alias("chat"), F.concat(F.lit("u"), _str(F.col("user_id") % 11)).alias("username"), F.concat(F.lit("N"), _str("user_id")).alias("nick")).distinct()
    return records.message_records(raw, ids, people, nicks, "me").select("chat", "db", "local_id", "sender", "is_self", "kind", "text", "nth")


def enrich_labels(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (3, 34, 43, 47))), (F.col("event_id") % 4 + 1).cast("int"))
    return _enriched(table(spark, d, "events"), "event_id", kind, F.concat(F.lit("<msg>"), "event_type", F.lit("</msg>"))).select("event_id", "kind", "text")


def enrich_location(spark, d):
    content = F.concat(F.lit('<msg><location x="'), _str("o_orderkey"), F.lit('.5" y="1.25" label="'), F.col("o_orderpriority"), F.lit('" poiname="'), F.col("o_orderstatus"), F.lit('"/></msg>'))
    rows = _enriched(table(spark, d, "orders"), "o_orderkey", F.lit(48), content)
    return rows.select("o_orderkey", "kind", "text", F.get_json_object("extra", "$.lat").cast("double").alias("lat"), F.get_json_object("extra", "$.poiname").alias("poiname"))


def enrich_card(spark, d):
    user = F.element_at(F.array(*[F.concat(F.lit(a), _str("c_custkey"), F.lit(b)) for a, b in (("gh_", ""), ("", "@chatroom"), ("u", "@openim"), ("u", ""))]), (F.col("c_custkey") % 4 + 1).cast("int"))
    content = F.concat(F.lit('<msg nickname="'), F.col("c_name"), F.lit('" username="'), user, F.lit('" certflag="0"/>'))
    rows = _enriched(table(spark, d, "customer"), "c_custkey", F.lit(42), content)
    return rows.select("c_custkey", "kind", "text", F.get_json_object("extra", "$.card_type").alias("card_type"))


def enrich_app_kinds(spark, d):
    """Ten app types in turn: text, music, file, sticker, live location, mini program, red packet, channels, notice, note."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    title = _tag("title", name)
    forms = [
        _app(1, title), _app(3, title, _tag("des", brand)), _app(6, title, F.lit("<appattach><totallen>"), _str(F.col("p_size") * 1000), F.lit("</totallen><fileext>pdf</fileext></appattach>")), _app(8, title), _app(17, title),
        _app(33, title, _tag("sourcedisplayname", brand)), _app(2001, _tag("title", F.lit("t")), _tag("wcpayinfo", _tag("receivertitle", kind))), _app(51, _tag("finderFeed", F.concat(_tag("nickname", brand), _tag("desc", name)))),
        _app(87, _tag("textannouncement", name)), _app(24, _tag("des", name)),
    ]
    content = F.element_at(F.array(*forms), (F.col("p_partkey") % 10 + 1).cast("int"))
    rows = _enriched(table(spark, d, "part"), "p_partkey", F.lit(49), content)
    return rows.select("p_partkey", "kind", "text", F.get_json_object("extra", "$.ext").alias("ext"), F.get_json_object("extra", "$.author").alias("author"))


def enrich_pat(spark, d):
    """Templates with two people, of whom those with even numbers are known: names come by a join on what each message mentions."""
    e = table(spark, d, "events")
    a, b = F.concat(F.lit("u"), _str(F.col("user_id"))), F.concat(F.lit("u"), _str(F.col("event_id") % 7))
    pat = F.concat(F.lit("<title></title><patinfo><fromusername>"), a, F.lit("</fromusername><pattedusername>"), b, F.lit("</pattedusername><template>${"), a, F.lit("} pats ${"), b, F.lit("}</template></patinfo>"))
    raw = e.select(F.col("user_id").alias("chat"), F.lit(0).alias("db"), F.col("event_id").alias("local_id"), F.lit(49).cast("long").alias("local_type"), _app(62, pat).alias("content"))
    people = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("u"), _str("c_custkey")).alias("username"), F.col("c_name").alias("display"))
    return enrich.enrich_messages(records.local_names(raw, people, F.col("content"))).select("local_id", "kind", "text", F.get_json_object("extra", "$.patted").alias("patted"))


def enrich_system(spark, d):
    e = table(spark, d, "events")
    revoke = F.concat(F.lit('<sysmsg type="revokemsg"><revokemsg><replacemsg>'), "event_type", F.lit(" recalled</replacemsg></revokemsg></sysmsg>"))
    even = F.col("event_id") % 2 == 0
    return _enriched(e, "event_id", F.when(even, 10000).otherwise(10002), F.when(even, F.concat(F.lit("<b>"), "event_type", F.lit("</b> joined"))).otherwise(revoke)).select("event_id", "kind", "text")


def enrich_malformed(spark, d):
    """Unclosed app XML, and a base type that nobody knows, short and long."""
    e = table(spark, d, "events")
    n = F.col("event_id") % 3
    broken = F.concat(F.lit("<msg><appmsg><title><![CDATA["), "event_type", F.lit("]]></title><type>5</type>"))
    content = F.when(n == 0, broken).when(n == 1, F.concat(F.lit("plain "), "event_type")).otherwise(F.repeat(F.lit("x"), 500))
    return _enriched(e, "event_id", F.when(n == 0, 49).otherwise(77), content).select("event_id", "kind", "text")


def bundle_items(spark, d):
    """Each turn forwarded as a text, and a bundle within the bundle with a link in it."""
    c = table(spark, d, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    inner = F.concat(F.lit('<recordinfo><datalist><dataitem datatype="5"><datatitle>L'), _str("turn"), F.lit("</datatitle><link>http://x/"), _str("turn"), F.lit("</link></dataitem></datalist></recordinfo>"))
    items = F.concat(
        F.lit('<recordinfo><datalist><dataitem datatype="1"><datadesc>n'), _str("conv_id"), F.lit("</datadesc><sourcename>"), "role", F.lit("</sourcename><srcMsgCreateTime>"), _str("turn"),
        F.lit('</srcMsgCreateTime></dataitem><dataitem datatype="17"><datatitle>in</datatitle><recordxml>'), escape_html(inner), F.lit("</recordxml></dataitem></datalist></recordinfo>"),
    )
    raw = c.select("key", F.lit(49).alias("base"), _app(19, _tag("title", F.lit("t")), _tag("recorditem", escape_html(items))).alias("content"))
    return enrich.bundle_items(raw, "key").select("key", F.concat_ws(".", F.transform("path", lambda p: p.cast("string"))).alias("path"), "depth", "sender", "ts", "kind", "text", "url")


def media_lengths(spark, d):
    o = table(spark, d, "orders")
    voice = F.col("o_orderkey") % 2 == 0
    content = F.when(voice, F.concat(F.lit('<msg><voicemsg voicelength="'), _str("o_orderkey"), F.lit('"/></msg>'))).otherwise(F.concat(F.lit('<msg><videomsg playlength = "'), _str(F.col("o_orderkey") % 5), F.lit('"/></msg>')))
    return o.select("o_orderkey", records.media_seconds(content, F.when(voice, "voice").otherwise("video")).alias("seconds"))


QUERIES = {f.__name__: f for f in (message_records, enrich_labels, enrich_location, enrich_card, enrich_app_kinds, enrich_pat, enrich_system, enrich_malformed, bundle_items, media_lengths)}

_SIZE = "CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', n / 1024.0) END"
ORACLES = {
    "message_records": """WITH e AS (SELECT *, CAST(event_id % 2 AS INT) AS db, event_id // 2 AS local_id, user_id % 2 = 1 AS grp, event_id % 7 AS id, CAST(floor(floor(epoch(ts)) / 3600) * 3600 AS BIGINT) AS t,
        CASE WHEN user_id % 2 = 1 THEN user_id || '@chatroom' ELSE 'u' || user_id END AS chat, 'u' || (event_id % 11) AS pu FROM events),
      k AS (SELECT *, CASE WHEN db = 0 THEN id ELSE 5 - id END AS k FROM e),
      s AS (SELECT *, CASE WHEN id = 6 THEN NULL WHEN k = 0 THEN '' WHEN k = 1 THEN 'me' ELSE 'u' || k END AS named FROM k),
      p AS (SELECT *, CASE WHEN grp AND coalesce(named, '') = '' THEN pu ELSE named END AS who, CASE WHEN grp AND named IS NOT DISTINCT FROM 'me' THEN pu || ':' || chr(10) || props ELSE props END AS text FROM s)
      SELECT chat, db, local_id, CASE WHEN who IS NULL THEN '未知(' || id || ')' WHEN who = 'me' THEN '我' WHEN who = '' THEN '系统' WHEN grp AND who = 'u' || (user_id % 11) THEN 'N' || user_id ELSE coalesce(c_name, who) END AS sender,
        coalesce(who = 'me', false) AS is_self, 'text' AS kind, text, row_number() OVER (PARTITION BY chat ORDER BY t, event_id % 3, db DESC, local_id) AS nth
      FROM p LEFT JOIN customer ON c_custkey % 2 = 0 AND who = 'u' || c_custkey""",
    "enrich_labels": """SELECT event_id, ['image', 'voice', 'video', 'emoji'][event_id % 4 + 1] AS kind, ['[图片]', '[语音]', '[视频]', '[表情]'][event_id % 4 + 1] AS text FROM events""",
    "enrich_location": "SELECT o_orderkey, 'location' AS kind, '[位置] ' || o_orderstatus || ' (' || o_orderpriority || ')' AS text, o_orderkey + 0.5::DOUBLE AS lat, o_orderstatus AS poiname FROM orders",
    "enrich_card": """SELECT c_custkey, 'card' AS kind, ['[公众号名片]', '[群名片]', '[企业微信名片]', '[名片]'][c_custkey % 4 + 1] || ' ' || c_name AS text,
      ['official', 'group', 'enterprise', 'person'][c_custkey % 4 + 1] AS card_type FROM customer""",
    "enrich_app_kinds": f"""WITH p AS (SELECT *, CAST(p_partkey % 10 AS INT) AS k, p_size * 1000 AS n FROM part)
      SELECT p_partkey, ['text', 'music', 'file', 'emoji', 'location', 'miniprogram', 'redpacket', 'channels', 'notice', 'note'][k + 1] AS kind,
        CASE k WHEN 0 THEN p_name WHEN 1 THEN '[音乐] ' || p_name || ' - ' || p_brand WHEN 2 THEN '[文件] ' || p_name || ' (' || {_SIZE} || ')' WHEN 3 THEN '[表情]' WHEN 4 THEN '[位置共享]'
          WHEN 5 THEN '[小程序] ' || p_name || ' (' || p_brand || ')' WHEN 6 THEN '[红包] ' || p_type WHEN 7 THEN '[视频号] ' || p_brand || ': ' || p_name WHEN 8 THEN '[群公告] ' || p_name ELSE '[笔记] ' || p_name END AS text,
        CASE WHEN k = 2 THEN 'pdf' END AS ext, CASE WHEN k = 7 THEN p_brand END AS author FROM p""",
    "enrich_pat": """SELECT event_id AS local_id, 'pat' AS kind, '[拍一拍] ' || coalesce(a.c_name, 'u' || user_id) || ' pats ' || coalesce(b.c_name, 'u' || (event_id % 7)) AS text, coalesce(b.c_name, 'u' || (event_id % 7)) AS patted
      FROM events LEFT JOIN customer a ON a.c_custkey = user_id AND a.c_custkey % 2 = 0 LEFT JOIN customer b ON b.c_custkey = event_id % 7 AND b.c_custkey % 2 = 0""",
    "enrich_system": "SELECT event_id, 'system' AS kind, '[系统消息] ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' joined' ELSE ' recalled' END AS text FROM events",
    "enrich_malformed": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'link' ELSE 'other' END AS kind,
      CASE event_id % 3 WHEN 0 THEN '[链接] ' || event_type WHEN 1 THEN 'plain ' || event_type ELSE '[消息类型:77]' END AS text FROM events""",
    "bundle_items": """WITH c AS (SELECT conv_id * 1000 + turn AS key, * FROM conversations)
      SELECT key, '0' AS path, 1 AS depth, role AS sender, turn AS ts, 'text' AS kind, 'n' || conv_id AS text, NULL AS url FROM c
      UNION ALL SELECT key, '1', 1, '', NULL, 'chat_history', '[聊天记录] in', NULL FROM c
      UNION ALL SELECT key, '1.0', 2, '', NULL, 'link', '[链接] L' || turn, 'http://x/' || turn FROM c""",
    "media_lengths": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey > 0 THEN greatest(1, CAST(floor(o_orderkey / 1000.0 + 0.5) AS BIGINT)) END WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS seconds FROM orders""",
}
