"""Views, media, exports and job states over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import scalars as S
from chatlake.operators import attach, bookmarks, chats, daily, feed, incremental, jobs, media, messages, render, render_records, search, views
from chatlake.plans.archive_queries import _CLOCK, _ESC, _X, _bookmarks, _export, _posts
from chatlake.plans.chat_queries import CV, EV
from chatlake.plans.message_queries import CURSOR, TERMS
from chatlake.session import table
from chatlake.sources.tables import conversation_messages, event_messages, seconds


def _str(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def page_cursor(spark, d):
    """The ten messages before a message that each chat names by its id."""
    ev = event_messages(spark, d)
    cursors = ev.groupBy("chat").agg(F.max(F.struct("local_id", "db")).alias("m")).select("chat", F.concat_ws(":", _str("m.db"), _str("m.local_id")).alias("cursor"))
    return messages.page(messages.with_cursor(ev, cursors), 10, before=F.col("at")).select("chat", "rn", "db", "local_id")


def page_envelope(spark, d):
    ev = event_messages(spark, d)
    return messages.page_envelope(ev, messages.page(ev, 7))


def search_envelope(spark, d):
    hits = search.search(conversation_messages(spark, d), TERMS, ["system"])
    some = messages.limited(hits, 25, F.col("ts").desc(), F.col("dbr").desc(), F.col("local_id").desc(), F.col("chat"))
    return some.select("chat", "local_id", "has_more")


def search_hits_named(spark, d):
    hits = search.search(conversation_messages(spark, d), TERMS, ["system"])
    names = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("chat"), F.col("c_name").alias("name"))
    return views.hits_with_names(hits, names).select("chat", "local_id", "chat_name")


def search_groups(spark, d):
    return views.grouped_hits(search.search(conversation_messages(spark, d), TERMS, ["system"])).select("chat", "local_id", "chat_rank", "nth")


def message_view(spark, d):
    return conversation_messages(spark, d).select("chat", *views.message_view())


def contact_profiles(spark, d):
    people = table(spark, d, "supplier").select(_str("s_suppkey").alias("username"), F.col("s_name").alias("display"))
    stats = messages.profile(event_messages(spark, d).withColumn("is_self", F.col("kind") == "view")).withColumn("chat", _str("chat"))
    members = table(spark, d, "lineitem").select(_str("l_orderkey").alias("room"), _str("l_suppkey").alias("member"))
    return views.contact_profiles(people, stats, members)


def posts_counts(spark, d):
    return feed.counts(_posts(spark, d))


def posts_export(spark, d):
    lines = render_records.post_lines(_posts(spark, d).filter("size(comments) > 0"), "txt")
    return lines.select("id", F.md5(F.col("line").cast("binary")).alias("digest"))


def posts_view(spark, d):
    """Posts with media as counts and comments cut off: every post of a user with more events has more comments."""
    return views.post_view(_posts(spark, d)).select("id", "kind", F.size("comments").alias("n_comments"), "comments_truncated", "n_likes")


def author_names(spark, d):
    posts = _posts(spark, d).select("username", F.lit("").alias("nickname")).distinct()
    people = table(spark, d, "region").select(F.concat(F.lit("src"), _str("r_regionkey")).alias("username"), F.col("r_name").alias("display"), F.lower("r_name").alias("remark"), F.lit(None).cast("string").alias("nick_name"), F.lit("").alias("alias"))
    return views.author_names(posts, people.unionByName(people.join(posts.select(F.col("username").alias("s")).distinct(), F.length("s") >= 0).withColumn("username", F.col("s")).drop("s")))


def bookmark_sources(spark, d):
    names = table(spark, d, "region").select(F.concat(F.lit("host"), _str("r_regionkey")).alias("username"), F.col("r_name").alias("display")).filter("username <> 'host2'")
    return views.with_sources(_bookmarks(spark, d), names, "host1").select("id", "from_name", "sender_name", "chat_name", "is_self", views.source_line().alias("line"))


def bookmark_detail(spark, d):
    hidden = table(spark, d, "region").filter("r_regionkey = 4").select(F.concat(F.lit("host"), _str("r_regionkey")).alias("username"))
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return views.bookmark_detail(_bookmarks(spark, d), wanted, hidden, "me").select("id", "ts", "kind", "title", "url", F.size("items").alias("n_items"), "items_truncated")


def bookmarks_export(spark, d):
    return render_records.bookmark_lines(_bookmarks(spark, d), "txt")


def _videos(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.md5(_str("vec_id").cast("binary")).alias("md5"))
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(x).alias("variant")) for m in ("2024-01", "2023-12", "2020-05") for x in ("", "_thumb")]))
    each = v.select("*", kinds.alias("k")).filter("vec_id % 5 <> 0 or k.month = '2020-05'").filter("vec_id % 7 <> 0 or k.variant = ''")
    head = F.when(F.col("vec_id") % 3 == 0, F.lit(b"\0\0\0\x18moovisom")).otherwise(F.lit(b"\0\0\0\x18ftypisom"))
    return each.select("md5", F.col("k.variant").alias("variant"), F.col("k.month").alias("month"), F.concat_ws("/", "k.month", F.concat(_str("vec_id"), "k.variant")).alias("path"), head.alias("head"))


def _video_messages(spark, d):
    return table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("chat"), F.lit(0).alias("db"), F.col("vec_id").alias("local_id"), F.lit(1704500000).cast("long").alias("ts"), F.md5(_str("vec_id").cast("binary")).alias("md5"))


def locate_videos(spark, d):
    return attach.locate_videos(_video_messages(spark, d), _videos(spark, d))


def attached_media(spark, d):
    """Records with the paths of their videos, and what became of them."""
    m = _video_messages(spark, d)
    found = attach.with_media(m, videos=attach.locate_videos(m, _videos(spark, d)))
    status = F.when(F.col("video_path").isNotNull(), "new").otherwise("missing")
    return attach.outcomes(found.select(F.lit("video").alias("kind"), status.alias("status"), (F.col("video_path").isNull() & F.col("poster_path").isNotNull()).alias("only_thumb")))


def resource_md5(spark, d):
    """Events that don't tell their image's hash get it from a table in which numbers repeat across shards."""
    ev = event_messages(spark, d).withColumn("md5", F.when(F.col("server_id") % 30 == 0, F.md5(_str("server_id").cast("binary"))))
    table_ = ev.filter("server_id % 20 = 0").select("chat", "local_id", "ts", F.md5(F.concat(_str("local_id"), F.lit("r")).cast("binary")).alias("md5"))
    return attach.with_resource_md5(ev.filter("db = 0"), table_).select("chat", "local_id", "ts", "md5")


def bookmark_files(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.md5(_str("vec_id").cast("binary")).alias("md5"))
    items = v.select(F.col("vec_id").alias("id"), F.lit(0).alias("pos"), F.upper("md5").alias("fullmd5"), F.md5(_str(F.col("vec_id") + 1).cast("binary")).alias("thumbmd5"))
    subs = v.select("vec_id", "md5", F.explode(F.array(F.lit("thumb"), F.lit("mid"), F.lit("data"))).alias("sub")).filter("vec_id % 2 = 0 or sub <> 'data'").filter("vec_id % 3 <> 0")
    return attach.bookmark_files(items, subs.select("md5", "sub", F.concat_ws("/", "sub", _str("vec_id")).alias("path")))


def existing_attachment(spark, d):
    p = table(spark, d, "part")
    files = p.select(_str(F.col("p_partkey") % 500).alias("stem"), F.element_at(F.array(F.lit("jpg"), F.lit("png"), F.lit("tmp")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("ext"), _str("p_partkey").alias("path"))
    return attach.existing_by_stem(p.select(_str("p_size").alias("stem")), files, ["png", "jpg"])


def stickers_merged(spark, d):
    e = table(spark, d, "events").groupBy(F.md5(_str(F.col("user_id") % 60).cast("binary")).alias("md5")).agg(F.min(F.when(F.col("event_type") == "view", F.concat(F.lit("http://m/"), _str("user_id"))).otherwise("")).alias("cdn_url")).withColumn("thumb_url", F.lit(""))
    known = table(spark, d, "supplier").filter("s_suppkey < 50").select(F.md5(_str("s_suppkey").cast("binary")).alias("md5"), F.concat(F.lit("http://t/"), _str("s_suppkey")).alias("cdn_url"), F.when(F.col("s_suppkey") % 2 == 0, "th").otherwise("").alias("thumb_url"))
    return media.merge_urls(e, known)


def sticker_states(spark, d):
    p = table(spark, d, "part")
    md5 = F.md5(_str("p_partkey").cast("binary")).alias("md5")
    of = lambda k: p.filter(f"p_partkey % {k} = 0").select(md5)
    asked = p.select(md5, F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("http://"), "p_name")).alias("cdn_url"))
    failed = p.filter("p_partkey % 7 = 0").select(md5, (F.lit(1700000000) - F.col("p_size") * 86400).alias("failed_at"))
    return media.sticker_status(asked, of(2), of(3), failed, 1700000000)


def failed_lately(spark, d):
    p = table(spark, d, "part").select(F.md5(_str("p_partkey").cast("binary")).alias("md5"), (F.lit(1700000000) - F.col("p_size") * 86400).alias("failed_at"))
    return jobs.recently_failed(p, 1700000000)


def first_bytes(spark, d):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n", b"GIF89a", b"BM00", b"RIFF0000WEBP", b"\0\0\0\x18ftypisom", b"????"]
    content = F.element_at(F.array(*map(F.lit, heads)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select(media.format_of(content).alias("format"), attach.media_profile(content, F.col("value"))["fmt"].alias("fmt")).groupBy("format", "fmt").agg(F.count(F.lit(1)).alias("n"))


def export_md(spark, d):
    return render.rendered(_export(spark, d), "md").select("chat", "local_id", F.md5(F.col("line").cast("binary")).alias("digest"))


def export_json(spark, d):
    lines = render.export_json(event_messages(spark, d).withColumns({"sender": _str("chat"), "is_self": F.col("kind") == "view", "text": F.col("kind")}))
    return lines.select("chat", "part", "db", "local_id", "line") if "db" in lines.columns else lines.select("chat", "part", "dbr", "local_id", "line")


def export_state_txt(spark, d):
    """The state of each chat's text export, read back from its lines."""
    lines = render.rendered(_export(spark, d), "txt").select("chat", F.col("ts").alias("pos"), F.explode(F.split("line", "\n")).alias("line"))
    return daily.export_tail_state(lines, "txt")


def export_state_csv(spark, d):
    ev = event_messages(spark, d).withColumns({"sender": _str("chat"), "is_self": F.col("kind") == "view", "text": F.col("extra"), "ts": F.floor(F.col("ts") / 86400).cast("long") * 86400})
    return daily.export_tail_state(render.rendered(ev, "csv").select("chat", F.col("ts").alias("pos"), "line"), "csv")


def export_state_md(spark, d):
    ev = incremental.tail_state(event_messages(spark, d))
    notes = ev.select("chat", F.lit(2).alias("pos"), daily.state_note(F.col("last_ts"), F.col("n_last")).alias("line")).unionByName(ev.select("chat", F.lit(1).alias("pos"), daily.state_note(F.lit(1).cast("long"), F.lit(1).cast("long")).alias("line")))
    return daily.export_tail_state(notes, "md")


def export_counts_html(spark, d):
    return daily.rendered_count(render.rendered(_export(spark, d), "html").select("chat", "line"), "html")


def export_file_names(spark, d):
    p = table(spark, d, "part").select(_str("p_partkey").alias("username"), F.col("p_name").alias("display"))
    return jobs.export_names(p, "txt")


def changed_documents(spark, d):
    """Chats whose export differs from the one without the messages of their odd shard."""
    ev = event_messages(spark, d).withColumns({"sender": _str("chat"), "is_self": F.lit(False), "text": F.col("kind")})
    return jobs.changed_documents(render.documents(ev, "txt"), render.documents(ev.filter("db = 0"), "txt")).select("chat")


def compact_view(spark, d):
    view = render_records.compact(_export(spark, d))
    return view.select("chat", F.md5(F.col("view").cast("binary")).alias("digest"))


def refresh_lists(spark, d):
    o = table(spark, d, "orders").select(_str("o_orderkey").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_totalprice").cast("long").alias("size"))
    now = o.filter("cast(path as long) % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("path").cast("long") % 7 == 0, 1).otherwise(0))
    return daily.refresh_lists(o.filter("cast(path as long) % 3 <> 0"), now, F.col("path").cast("long") % 11 != 0)


def _plan(spark, d):
    c = table(spark, d, "customer")
    action = F.element_at(F.array(*map(F.lit, ("skip", "append", "rebuild", "drop"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("chat"), action.alias("action"))


def sync_stats(spark, d):
    added = event_messages(spark, d).groupBy("chat").agg(F.count(F.lit(1)).alias("n"))
    return daily.sync_stats(_plan(spark, d), added)


def sync_scoped(spark, d):
    only = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chat"))
    return daily.scoped_plan(_plan(spark, d), only)


def sync_rebuild(spark, d):
    return daily.plan_for_version(_plan(spark, d), (1, "a"), (2, "a"))


def run_rollup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), (seconds("o_orderdate") * 100000 + F.col("o_orderkey")).alias("time"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), (F.col("o_orderkey") % 100).cast("double").alias("seconds"))
    return daily.run_rollup(o)


def last_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), (seconds("o_orderdate") * 100000 + F.col("o_orderkey")).alias("time"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))
    return jobs.last_run(o).select("job", F.col("last.time").alias("time"), F.col("last.status").alias("status"), "runs", "failures")


def scalar_mix(spark, d):
    o = table(spark, d, "orders")
    k = _str("o_orderkey")
    return o.select(
        "o_orderkey", S.to_long(F.concat(F.lit(" "), k, F.lit(" "))).alias("as_long"), S.to_long(F.concat(k, F.lit("x"))).alias("no_long"), S.to_double(F.concat(k, F.lit(".5"))).alias("as_double"), S.unsigned_id(-F.col("o_orderkey")).alias("unsigned"),
        S.strip_tags(F.concat(F.lit("<a href='x'>"), "o_orderpriority", F.lit("</a> "))).alias("plain"), S.voice_stem(F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_orderkey")), F.lit(5), F.col("o_custkey")).alias("stem"),
        S.relative_path(F.concat(F.lit("/out/a b/"), k), F.lit("/out"), quoted=True).alias("path"), S.duration_label(F.col("o_orderkey")).alias("duration"), S.parse_message_id(F.concat(F.lit("1:"), k))["local_id"].alias("number"),
    )


def hosts_allowed(spark, d):
    host = S.url_host(F.col("url"))
    return table(spark, d, "pages").select("page_id", S.host_allowed(host, ["example.net", "org"]).alias("allowed"), S.link_text(F.concat(F.lit("["), "url", F.lit("] <x>"))).alias("text"))


def persons_only(spark, d):
    """Accounts that are nobody: official, built in, or verified and without a person's name."""
    c = table(spark, d, "customer")
    user = F.element_at(F.array(F.concat(F.lit("gh_"), _str("c_custkey")), F.lit("weixin"), F.concat(F.lit("wxid_"), _str("c_custkey")), F.concat(F.lit("shop"), _str("c_custkey")), F.concat(_str("c_custkey"), F.lit("@chatroom"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", chats.is_not_a_person(user, (F.col("c_custkey") % 2).cast("int")).alias("service"), chats.is_group_name(user).alias("is_group"))


QUERIES = {f.__name__: f for f in (
    page_cursor, page_envelope, search_envelope, search_hits_named, search_groups, message_view, contact_profiles, posts_counts, posts_export, posts_view, author_names, bookmark_sources, bookmark_detail, bookmarks_export,
    locate_videos, attached_media, resource_md5, bookmark_files, existing_attachment, stickers_merged, sticker_states, failed_lately, first_bytes, export_md, export_json, export_state_txt, export_state_csv, export_state_md,
    export_counts_html, export_file_names, changed_documents, compact_view, refresh_lists, sync_stats, sync_scoped, sync_rebuild, run_rollup, last_runs, scalar_mix, hosts_allowed, persons_only,
)}

_HITS = f"WITH {CV}, hits AS (SELECT * FROM cv WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND kind <> 'system')"
_NEWEST = "ts DESC, dbr DESC, local_id DESC"
_PLAN = "p AS (SELECT c_custkey AS chat, ['skip', 'append', 'rebuild', 'drop'][c_custkey % 4 + 1] AS action FROM customer)"
_DONE = "CAST(floor(epoch(o_orderdate)) AS BIGINT) * 100000 + o_orderkey"
_COMMENTS = "c AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY user_id)"
_VID = "v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN '2020-05' ELSE '2024-01' END AS month FROM embeddings)"

ORACLES = {
    "page_cursor": f"""WITH {EV}, m AS (SELECT chat, max((local_id, db)) AS m FROM ev GROUP BY chat), a AS (SELECT ev.chat, ts, dbr, local_id FROM ev JOIN m ON ev.chat = m.chat AND (local_id, db) = m.m),
      p AS (SELECT ev.* FROM ev JOIN a ON ev.chat = a.chat AND (ev.ts, ev.dbr, ev.local_id) < (a.ts, a.dbr, a.local_id) QUALIFY row_number() OVER (PARTITION BY ev.chat ORDER BY ev.ts DESC, ev.dbr DESC, ev.local_id DESC) <= 10)
      SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY ts, dbr, local_id) AS rn, db, local_id FROM p""",
    "page_envelope": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts DESC, dbr DESC, local_id DESC) AS b, count(*) OVER (PARTITION BY chat) AS n FROM ev)
      SELECT chat, least(max(n), 7) AS count, max(n) > 7 AS has_more_before, false AS has_more_after, max(CASE WHEN b = least(n, 7) THEN db || ':' || local_id END) AS before_cursor, max(CASE WHEN b = 1 THEN db || ':' || local_id END) AS after_cursor
      FROM r GROUP BY chat""",
    "search_envelope": f"{_HITS} SELECT chat, local_id, (SELECT count(*) FROM hits) > 25 AS has_more FROM hits ORDER BY {_NEWEST}, chat LIMIT 25",
    "search_hits_named": f"{_HITS} SELECT chat, local_id, coalesce(c_name, CAST(chat AS VARCHAR)) AS chat_name FROM hits LEFT JOIN customer ON c_custkey = chat AND c_custkey % 2 = 0",
    "search_groups": f"""{_HITS}, g AS (SELECT chat, row_number() OVER (ORDER BY max((ts, dbr, local_id)) DESC, chat) AS chat_rank FROM hits GROUP BY chat)
      SELECT hits.chat, local_id, chat_rank, row_number() OVER (PARTITION BY hits.chat ORDER BY {_NEWEST}) AS nth FROM hits JOIN g ON g.chat = hits.chat""",
    "message_view": f"""WITH {CV} SELECT chat, db || ':' || local_id AS id, ts, sender, CASE WHEN kind <> 'text' THEN kind END AS kind,
      CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…[+' || (length(text) - 4000) || ' chars]' ELSE text END AS text FROM cv""",
    "contact_profiles": """WITH e AS (SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS a, CAST(floor(epoch(max(ts))) AS BIGINT) AS b FROM events GROUP BY user_id),
      r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
      SELECT CAST(s_suppkey AS VARCHAR) AS username, s_name AS display, false AS is_group, coalesce(e.n, 0) AS msg_count, e.a AS first_ts, e.b AS last_ts, r.n AS member_count, coalesce(s.n, 0) AS shared_group_count
      FROM supplier LEFT JOIN e ON user_id = s_suppkey LEFT JOIN r ON l_orderkey = s_suppkey LEFT JOIN s ON s.l_suppkey = s_suppkey""",
    "posts_counts": f"WITH {_COMMENTS} SELECT CAST(doc_id AS VARCHAR) AS id, 0 AS images, 0 AS videos, 0 AS n_likes, coalesce(c.n, 0) AS n_comments FROM documents LEFT JOIN c ON user_id = doc_id",
    "posts_export": rf"""WITH e AS (SELECT user_id, string_agg('  u' || event_id || ': ' || event_type, chr(10) ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id DESC) AS said FROM events WHERE event_type <> 'error' GROUP BY user_id),
      p AS (SELECT doc_id, '[' || {_CLOCK.format('n_chars + 1000')} || '] ' || source || ' ' || CASE WHEN lang = 'en' THEN '[文字]' ELSE '[图片]' END AS head,
        nullif(trim(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')), '') AS body FROM documents)
      SELECT CAST(doc_id AS VARCHAR) AS id, md5(concat_ws(chr(10), head, body, said)) AS digest FROM p JOIN e ON user_id = doc_id""",
    "posts_view": f"""WITH {_COMMENTS} SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'text' END AS kind, least(coalesce(c.n, 0), 100) AS n_comments, CASE WHEN c.n > 100 THEN c.n - 100 END AS comments_truncated, 0 AS n_likes
      FROM documents LEFT JOIN c ON user_id = doc_id""",
    "author_names": "SELECT DISTINCT source AS username, source AS name FROM documents UNION SELECT DISTINCT source, r_name FROM documents, region UNION SELECT DISTINCT source, lower(r_name) FROM documents, region",
    "bookmark_sources": """WITH b AS (SELECT page_id AS id, page_id % 5 AS k FROM pages)
      SELECT id, CASE WHEN k = 2 THEN 'host2' ELSE r_name END AS from_name, CASE WHEN k = 1 THEN '我' WHEN k = 2 THEN 'host2' ELSE r_name END AS sender_name, NULL AS chat_name, k = 1 AS is_self,
        CASE WHEN k = 1 THEN '我' WHEN k = 2 THEN 'host2' ELSE r_name END AS line FROM b JOIN region ON r_regionkey = k""",
    "bookmark_detail": """SELECT DISTINCT page_id AS id, page_id * 60 AS ts, 'link' AS kind, 'Page ' || page_id AS title, url, 0 AS n_items, NULL AS items_truncated FROM pages JOIN labels ON doc_id = page_id WHERE page_id % 5 <> 4 AND page_id > 0
      UNION ALL SELECT DISTINCT page_id, 0, 'link', 'Page ' || page_id, url, 0, NULL FROM pages JOIN labels ON doc_id = page_id WHERE page_id = 0""",
    "bookmarks_export": f"""SELECT page_id AS id, CASE WHEN page_id > 0 THEN '[' || {_CLOCK.format('page_id * 60')} || '] ' ELSE '' END || '[链接] Page ' || page_id || CASE WHEN regexp_matches(url, '(?i)^https?://') THEN chr(10) || url ELSE '' END
      || chr(10) || '#even' || (page_id % 2) AS line FROM pages""",
    "locate_videos": f"""WITH {_VID} SELECT vec_id % 10 AS chat, 0 AS db, vec_id AS local_id, CASE WHEN vec_id % 3 <> 0 THEN month || '/' || vec_id END AS video, CASE WHEN vec_id % 7 <> 0 THEN month || '/' || vec_id || '_thumb' END AS poster FROM v""",
    "attached_media": """SELECT 'video' AS kind, count(*) FILTER (vec_id % 3 <> 0) AS new, 0 AS existing, count(*) FILTER (vec_id % 3 = 0) AS missing, 0 AS failed, count(*) FILTER (vec_id % 3 = 0 AND vec_id % 7 <> 0) AS thumb_only FROM embeddings""",
    "resource_md5": f"""WITH {EV}, t AS (SELECT DISTINCT chat, local_id, ts FROM ev WHERE server_id % 20 = 0)
      SELECT chat, local_id, ts, CASE WHEN server_id % 30 = 0 THEN md5(CAST(server_id AS VARCHAR)) ELSE md5(local_id || 'r') END AS md5 FROM ev WHERE db = 0""",
    "bookmark_files": """WITH v AS (SELECT vec_id AS i, vec_id + 1 AS j FROM embeddings), top AS (SELECT max(vec_id) AS m FROM embeddings)
      SELECT i AS id, 0 AS pos, CASE WHEN i % 3 <> 0 THEN CASE WHEN i % 2 = 0 THEN 'data/' ELSE 'mid/' END || i END AS data,
        CASE WHEN j % 3 <> 0 AND j <= m THEN CASE WHEN j % 2 = 0 THEN 'data/' ELSE 'mid/' END || j END AS thumb FROM v, top""",
    "existing_attachment": """WITH f AS (SELECT p_partkey % 500 AS stem, p_partkey % 3 AS x, CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey % 3 < 2)
      SELECT CAST(stem AS VARCHAR) AS stem, path FROM f WHERE stem IN (SELECT p_size FROM part) QUALIFY row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN x = 1 THEN 0 ELSE 1 END, path) = 1""",
    "stickers_merged": """WITH e AS (SELECT user_id % 60 AS k, min(CASE WHEN event_type = 'view' THEN 'http://m/' || user_id ELSE '' END) AS u FROM events GROUP BY 1)
      SELECT md5(CAST(k AS VARCHAR)) AS md5, coalesce(nullif(u, ''), CASE WHEN s_suppkey IS NOT NULL THEN 'http://t/' || k END) AS cdn_url, CASE WHEN s_suppkey % 2 = 0 THEN 'th' END AS thumb_url FROM e LEFT JOIN supplier ON s_suppkey = k AND s_suppkey < 50""",
    "sticker_states": """SELECT md5(CAST(p_partkey AS VARCHAR)) AS md5, CASE WHEN p_partkey % 2 = 0 THEN 'cached' WHEN p_partkey % 3 = 0 THEN 'local' WHEN p_partkey % 11 = 0 THEN 'unavailable'
      WHEN p_partkey % 7 = 0 AND p_size < 7 THEN 'failed' ELSE 'fetch' END AS status FROM part""",
    "failed_lately": "SELECT DISTINCT md5(CAST(p_partkey AS VARCHAR)) AS md5 FROM part WHERE p_size < 7",
    "first_bytes": "WITH x AS (SELECT ['jpg', 'png', 'gif', 'bmp', 'webp', 'mp4', 'bin'][event_id % 7 + 1] AS f FROM events) SELECT f AS format, f AS fmt, count(*) AS n FROM x GROUP BY f",
    "export_md": f"""WITH {_X}, z AS (SELECT *, substr(clock, 1, 10) AS day FROM y), w AS (SELECT *, coalesce(day <> lag(day) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS fresh FROM z)
      SELECT chat, local_id, md5(CASE WHEN fresh THEN '## ' || day || chr(10) || chr(10) ELSE '' END || '**' || sender || '** ' || substr(clock, 12, 5) || '  ' || chr(10) || replace(text, '<', '&lt;') || chr(10)) AS digest FROM w""",
    "export_json": f"""WITH {EV}, l AS (SELECT *, (ts, dbr, local_id) = max((ts, dbr, local_id)) OVER (PARTITION BY chat) AS last FROM ev)
      SELECT chat, 1 AS part, dbr, local_id, '{{"ts":' || ts || ',"time":"' || {_CLOCK.format('ts')} || '","sender":"' || chat || '","is_self":' || CASE WHEN kind = 'view' THEN 'true' ELSE 'false' END || ',"kind":"' || kind || '","text":"' || kind || '"}}'
        || CASE WHEN last THEN '' ELSE ',' END AS line FROM l
      UNION ALL SELECT chat, 0, NULL, NULL, '{{"chat":{{"chat":' || chat || '}},"messages":[' FROM ev GROUP BY chat UNION ALL SELECT chat, 2, NULL, NULL, ']}}' FROM ev GROUP BY chat""",
    "export_state_txt": f"""WITH {_X} SELECT chat, max(ts) AS last_ts, arg_max(n, ts) AS n_last, CAST(sum(n) AS BIGINT) AS rendered FROM (SELECT chat, ts, count(*) AS n FROM y GROUP BY ALL) GROUP BY chat""",
    "export_state_csv": f"""WITH {EV}, t AS (SELECT chat, ts // 86400 * 86400 AS ts, count(*) AS n FROM ev GROUP BY ALL) SELECT chat, max(ts) AS last_ts, arg_max(n, ts) AS n_last, CAST(sum(n) AS BIGINT) AS rendered FROM t GROUP BY chat""",
    "export_state_md": f"WITH {EV}, t AS (SELECT chat, ts, count(*) AS n FROM ev GROUP BY ALL) SELECT chat, max(ts) AS last_ts, arg_max(n, ts) AS n_last, NULL AS rendered FROM t GROUP BY chat",
    "export_counts_html": f"WITH {CV} SELECT chat, count(*) AS rendered FROM cv GROUP BY chat",
    "export_file_names": """SELECT CAST(p_partkey AS VARCHAR) AS username, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || p_partkey ELSE p_name END || '_chat.txt' AS filename FROM part""",
    "changed_documents": f"WITH {EV} SELECT chat FROM ev GROUP BY chat HAVING count(*) FILTER (db = 1) > 0",
    "compact_view": f"""WITH {_X}, z AS (SELECT *, substr(clock, 1, 10) AS day FROM y), w AS (SELECT *, coalesce(day <> lag(day) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS fresh FROM z)
      SELECT chat, md5(string_agg(CASE WHEN fresh THEN '-- ' || day || chr(10) ELSE '' END || substr(clock, 12, 5) || ' ' || sender || ': ' || text, chr(10) ORDER BY ts, dbr, local_id)) AS digest FROM w GROUP BY chat""",
    "refresh_lists": """WITH o AS (SELECT o_orderkey AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders),
      b AS (SELECT * FROM o WHERE k % 3 <> 0), n AS (SELECT k, mtime, size + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS size FROM o WHERE k % 5 <> 0),
      s AS (SELECT coalesce(b.k, n.k) AS k, n.size AS size, CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'missing' WHEN b.mtime = n.mtime AND b.size = n.size THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN n ON b.k = n.k)
      SELECT CAST(k AS VARCHAR) AS path, CASE WHEN status IN ('new', 'changed') AND k % 11 = 0 THEN 'failed' ELSE status END AS status, size FROM s""",
    "sync_stats": f"""WITH {_PLAN}, a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (action = 'append') AS appended, count(*) FILTER (action = 'rebuild') AS rebuilt,
      count(*) FILTER (action = 'drop') AS dropped, CAST(coalesce(sum(n), 0) AS BIGINT) AS added FROM p LEFT JOIN a ON user_id = chat""",
    "sync_scoped": f"WITH {_PLAN} SELECT chat, action FROM p WHERE chat IN (SELECT s_suppkey FROM supplier)",
    "sync_rebuild": f"WITH {_PLAN} SELECT chat, CASE WHEN action = 'drop' THEN 'drop' ELSE 'rebuild' END AS action FROM p",
    "run_rollup": f"""WITH r AS (SELECT o_custkey AS job, {_DONE} AS time, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status, o_orderkey % 100 AS s FROM orders)
      SELECT job, count(*) AS runs, count(*) FILTER (status <> 'ok') AS failures, max(time) AS last_time, arg_max(status, time) AS last_status, avg(s) AS mean_seconds, max(s)::DOUBLE AS longest FROM r GROUP BY job""",
    "last_runs": f"""WITH r AS (SELECT o_custkey AS job, {_DONE} AS time, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status FROM orders)
      SELECT job, max(time) AS time, arg_max(status, time) AS status, count(*) AS runs, count(*) FILTER (status <> 'ok') AS failures FROM r GROUP BY job""",
    "scalar_mix": """SELECT o_orderkey, o_orderkey AS as_long, NULL AS no_long, o_orderkey + 0.5::DOUBLE AS as_double, CASE WHEN o_orderkey = 0 THEN '0' ELSE CAST(18446744073709551616::HUGEINT - o_orderkey AS VARCHAR) END AS unsigned, o_orderpriority AS plain,
      CASE WHEN o_orderkey % 2 = 0 THEN '5_' || o_custkey ELSE CAST(o_orderkey AS VARCHAR) END AS stem, 'a%20b/' || o_orderkey AS path,
      CASE WHEN o_orderkey >= 60 THEN (o_orderkey // 60) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') ELSE o_orderkey || '"' END AS duration, o_orderkey AS number FROM orders""",
    "hosts_allowed": r"""WITH h AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) END AS host FROM pages)
      SELECT page_id, coalesce(host IN ('example.net', 'org') OR host LIKE '%.example.net' OR host LIKE '%.org', false) AS allowed, '\[' || replace(replace(url, '[', '\['), ']', '\]') || '\] &lt;x>' AS text FROM h""",
    "persons_only": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN c_custkey % 2 = 1 ELSE false END AS service, c_custkey % 5 = 4 AS is_group FROM customer""",
}
