"""Queries over two shards whose numbers repeat, over two export runs, and over a stream of two landings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import attach, daily, media, merkle, search
from chatlake.plans.chat_queries import EV
from chatlake.plans.message_queries import CURSOR
from chatlake.session import scratch_dir
from chatlake.sources.tables import event_messages
from chatlake.streaming import keyed_tail as tails


def _str(c):
    return F.col(c).cast("string")


def _said(spark, d):
    return event_messages(spark, d).withColumn("text", F.concat_ws(" ", "kind", "extra"))


def trigram_search_shards(spark, d):
    """Hits whose numbers stand in both shards, from postings that an append has doubled."""
    ev = _said(spark, d)
    postings = search.trigram_postings(ev)
    return search.trigram_search(ev, postings.unionByName(postings), ["Click", "k"], ["error"]).select("chat", "db", "local_id")


def _image_messages(spark, d):
    ev = event_messages(spark, d).filter("kind = 'view'")
    return ev.withColumn("md5", F.md5(F.concat_ws("-", _str("chat"), _str("db"), _str("local_id")).cast("binary")))


def _images(messages):
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(x).alias("variant")) for m in ("2020-01", "2019-05") for x in media.VARIANTS]))
    each = messages.select("chat", "db", "local_id", "md5", kinds.alias("k")).filter("local_id % 4 <> 0").filter("db = 1 or k.variant <> '_h'")
    return each.select("chat", "md5", F.col("k.month").alias("month"), F.col("k.variant").alias("variant"), F.concat_ws("/", "k.month", _str("db"), F.concat(_str("local_id"), "k.variant")).alias("path"))


def media_locate_shards(spark, d):
    m = _image_messages(spark, d)
    return media.locate_images(m, _images(m))


def attached_all_media(spark, d):
    """Records with the paths of their images and the blobs of their voices."""
    ev = event_messages(spark, d)
    pictures, voices = _image_messages(spark, d), ev.filter("kind = 'click'")
    blobs = voices.filter("local_id % 3 <> 0").select(F.lit(0).alias("store"), "chat", "server_id", "ts", "local_id", F.lit("0").alias("data_index"), F.concat_ws(":", _str("db"), _str("local_id")).cast("binary").alias("data"))
    found = attach.with_media(ev, images=media.locate_images(pictures, _images(pictures)), voices=media.locate_voices(voices, blobs))
    return found.select("chat", "db", "local_id", "image_path", F.col("voice").cast("string").alias("voice"), "voice_stem")


def stickers_last(spark, d):
    """What the last message of each sticker says about it, entities undone."""
    ev = event_messages(spark, d)
    content = F.concat(F.lit('<emoji md5="'), F.upper(F.md5((F.col("chat") % 50).cast("string").cast("binary"))), F.lit('" cdnurl="http://s?a=1&amp;b=&#'), (65 + F.col("server_id") / 10 % 26).cast("int").cast("string"), F.lit(';&amp;#66;" thumburl=""/>'))
    rows = ev.withColumn("_a", media.sticker_info(F.when(F.col("kind") == "view", content).otherwise('<emoji md5="none"/>')))
    rows = rows.select("ts", "dbr", "local_id", "server_id", media.sticker_md5(F.col("_a")).alias("md5"), F.try_element_at("_a", F.lit("cdnurl")).alias("cdn_url"), F.try_element_at("_a", F.lit("thumburl")).alias("thumb_url"))
    return media.distinct_stickers(rows, ("ts", "dbr", "local_id", "server_id"))


def _two_runs(fmt):
    def query(spark, d):
        rows = event_messages(spark, d).withColumns({"sender": _str("chat"), "is_self": F.col("kind") == "view", "text": F.concat_ws(" ", "kind", "extra")})
        out = scratch_dir(spark, "exports")
        daily.export_all(rows.filter(F.col("ts") < CURSOR), fmt, out, "1")
        daily.export_all(rows, fmt, out, "2")
        return daily.exported_digests(spark, fmt, out)

    query.__name__ = f"export_runs_{fmt}"
    query.__doc__ = "Each chat's document after two runs."
    return query


def keyed_tail(spark, d):
    """What the streamed export of two landings emits; of a chat that has gone on, earlier rows come too late."""
    root = scratch_dir(spark, "tail")
    ev = event_messages(spark, d).select("chat", "db", "dbr", "local_id", "ts", "kind")
    first = (F.col("ts") < CURSOR) & (F.col("local_id") % 5 != 0) & (F.col("chat") % 7 != 0)
    held = spark.conf.get(tails.PROVIDER)
    tails.use_rocksdb(spark)
    try:
        for rows in (ev.filter(first), ev.filter(~first)):
            rows.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
            tails.append(tails.new_rows(tails.with_formats(stream, ["txt", "md"])), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(tails.PROVIDER, held)
    return spark.read.parquet(f"{root}/out").select("fmt", "chat", "db", "local_id")


def _before_and_now(spark, d):
    """Events, and events of which some have changed their kind with another, so that the sum of kinds is the same, some are gone and some are new."""
    ev = event_messages(spark, d).select("chat", "db", "local_id", "kind", "extra")
    before = ev.filter("chat % 13 <> 1")
    edited = F.when(F.col("local_id") % 97 == 0, F.lit("edited")).otherwise(F.col("extra"))
    return before, ev.filter("chat % 11 <> 2 or local_id % 3 <> 0").withColumn("extra", edited)


def _changes(spark, before, now):
    root = scratch_dir(spark, "trees")
    for name, rows in (("before", before), ("now", now)):
        merkle.write_tree(merkle.tree(rows, ["kind", "extra"], bits=4, levels=3), f"{root}/{name}")
    return merkle.changed_ranges(spark.read.parquet(f"{root}/before"), spark.read.parquet(f"{root}/now"), bits=4, levels=3)


def merkle_changes(spark, d):
    return _changes(spark, *_before_and_now(spark, d))


def merkle_rebuilt(spark, d):
    """The stored rows, brought up to date by the changed ranges alone."""
    before, now = _before_and_now(spark, d)
    return merkle.rebuilt(before, now, _changes(spark, before, now), bits=4)


_RUNS = {fmt: _two_runs(fmt) for fmt in ("txt", "csv", "md", "html")}
QUERIES = {f.__name__: f for f in (trigram_search_shards, media_locate_shards, attached_all_media, stickers_last, keyed_tail, merkle_changes, merkle_rebuilt, *_RUNS.values())}

_CLOCK = "strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_DOC = f"{EV}, x AS (SELECT *, kind || ' ' || extra AS text, {_CLOCK} AS clock FROM ev), y AS (SELECT *, coalesce(substr(clock, 1, 10) <> lag(substr(clock, 1, 10)) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS fresh FROM x)"


def _document(line, head="''", end="''"):
    return f"""WITH {_DOC}, n AS (SELECT chat, max(ts) AS last, count(*) FILTER (ts = (SELECT max(ts) FROM y z WHERE z.chat = y.chat)) AS n FROM y GROUP BY chat),
      t AS (SELECT chat, {head} || string_agg({line} || chr(10), '' ORDER BY ts, dbr, local_id) AS doc FROM y GROUP BY chat), w AS (SELECT chat, doc || {end} AS doc FROM t JOIN n USING (chat))
      SELECT CAST(chat AS VARCHAR) AS chat, strlen(doc) AS size, sha256(doc) AS sha256 FROM w"""


_DAY = "CASE WHEN fresh THEN {} ELSE '' END"
_NOW = f"""WITH {EV}, b AS (SELECT chat, db, local_id, kind, extra FROM ev WHERE chat % 13 <> 1),
      n AS (SELECT chat, db, local_id, kind, CASE WHEN local_id % 97 = 0 THEN 'edited' ELSE extra END AS extra FROM ev WHERE chat % 11 <> 2 OR local_id % 3 <> 0)"""
ORACLES = {
    "merkle_changes": f"""{_NOW}, d AS (SELECT DISTINCT chat, db, local_id >> 4 AS r FROM b FULL JOIN n USING (chat, db, local_id) WHERE b.extra IS DISTINCT FROM n.extra OR b.kind IS DISTINCT FROM n.kind)
      SELECT chat, db, r << 4 AS lo, (r << 4) + 15 AS hi, CASE WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.chat = d.chat AND b.db = d.db AND b.local_id >> 4 = r) THEN 'new'
        WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.chat = d.chat AND n.db = d.db AND n.local_id >> 4 = r) THEN 'gone' ELSE 'changed' END AS status FROM d""",
    "merkle_rebuilt": f"{_NOW} SELECT * FROM n",
    "trigram_search_shards": f"WITH {EV} SELECT chat, db, local_id FROM ev WHERE kind <> 'error' AND contains(lower(kind || ' ' || extra), 'click') AND contains(lower(kind || ' ' || extra), 'k')",
    "media_locate_shards": f"""WITH {EV} SELECT chat, db, local_id, '2020-01/' || db || '/' || local_id || CASE WHEN db = 1 THEN '_h' ELSE '' END AS path FROM ev WHERE kind = 'view' AND local_id % 4 <> 0""",
    "attached_all_media": f"""WITH {EV} SELECT chat, db, local_id, CASE WHEN kind = 'view' AND local_id % 4 <> 0 THEN '2020-01/' || db || '/' || local_id || CASE WHEN db = 1 THEN '_h' ELSE '' END END AS image_path,
      CASE WHEN kind = 'click' AND local_id % 3 <> 0 THEN db || ':' || local_id END AS voice, CASE WHEN kind = 'click' AND local_id % 3 <> 0 THEN CASE WHEN server_id <> 0 THEN CAST(server_id AS VARCHAR) ELSE ts || '_' || local_id END END AS voice_stem FROM ev""",
    "stickers_last": f"""WITH {EV}, s AS (SELECT *, md5(CAST(chat % 50 AS VARCHAR)) AS md5 FROM ev WHERE kind = 'view')
      SELECT md5, 'http://s?a=1&b=' || chr(CAST(65 + arg_max(server_id, (ts, dbr, local_id, server_id)) // 10 % 26 AS INT)) || '&#66;' AS cdn_url, '' AS thumb_url, count(*) AS n FROM s GROUP BY md5""",
    "keyed_tail": f"""WITH {EV}, a AS (SELECT *, ts < {CURSOR} AND local_id % 5 <> 0 AND chat % 7 <> 0 AS early FROM ev), l AS (SELECT chat, max(ts) AS last FROM a WHERE early GROUP BY chat),
      k AS (SELECT a.* FROM a LEFT JOIN l USING (chat) WHERE early OR last IS NULL OR ts >= last) SELECT fmt, chat, db, local_id FROM k, (VALUES ('txt'), ('md')) f(fmt)""",
    "export_runs_txt": _document("'[' || clock || '] ' || chat || ': ' || text"),
    "export_runs_csv": _document("""clock || ',' || chat || ',' || CASE WHEN kind = 'view' THEN 1 ELSE 0 END || ',' || kind || ',' || CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END""", "chr(65279) || 'time,sender,is_self,kind,text' || chr(10)"),
    "export_runs_md": _document(_DAY.format("'## ' || substr(clock, 1, 10) || chr(10) || chr(10)") + " || '**' || chat || '** ' || substr(clock, 12, 5) || '  ' || chr(10) || replace(text, '<', '&lt;') || chr(10)", end="'<!-- state: last=' || last || ' n=' || n || ' -->' || chr(10)"),
    "export_runs_html": _document(_DAY.format("""'<div class="day">' || substr(clock, 1, 10) || '</div>' || chr(10)""") + f""" || '<div class="msg ' || CASE WHEN kind = 'view' THEN 'self' ELSE 'other' END || '"><b>' || chat || '</b><p>' || {_ESC.format('text')} || '</p></div>'"""),
}
