"""Paging, search, context, as-of and incremental queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.scalars import cap_text, one_line, snippet
from chatlake.operators import incremental, messages, search
from chatlake.plans.chat_queries import CV, EV
from chatlake.session import table
from chatlake.sources.tables import conversation_messages, event_messages

SINCE, UNTIL = 1704326400, 1705622400
TERMS, SHORT = ["the", "ing"], "Th"
CURSOR = 1705000000


def _cursor():
    return F.struct(F.lit(CURSOR).cast("long").alias("ts"), F.lit(0).alias("dbr"), F.lit(0).cast("long").alias("local_id"))


def _before():
    """The place before every message of the cursor's second, whatever its shard."""
    return F.struct(F.lit(CURSOR).cast("long").alias("ts"), F.lit(-(2**31)).cast("int").alias("dbr"), F.lit(-(2**63)).cast("long").alias("local_id"))


def _paged(df):
    return df.select("chat", "rn", "db", "local_id", "ts", "kind")


def page_backward(spark, d):
    return _paged(messages.page(event_messages(spark, d), 10, before=_before()))


def page_forward(spark, d):
    return _paged(messages.page(event_messages(spark, d), 10, after=_cursor()))


def page_from_start(spark, d):
    return _paged(messages.page(event_messages(spark, d), 10, from_start=True))


def page_last(spark, d):
    return _paged(messages.page(event_messages(spark, d), 10))


def page_has_more(spark, d):
    ranged = event_messages(spark, d).filter(messages.in_range(F.col("ts"), SINCE, UNTIL))
    return messages.page_flags(ranged, messages.page(ranged, 5, before=_before()))


def time_range_inclusive(spark, d):
    return event_messages(spark, d).filter(messages.in_range(F.col("ts"), SINCE, UNTIL)).groupBy("chat").agg(F.count(F.lit(1)).alias("n"))


def time_range_halfopen(spark, d):
    return event_messages(spark, d).filter(messages.in_range(F.col("ts"), SINCE, UNTIL, half_open=True)).groupBy("chat").agg(F.count(F.lit(1)).alias("n"))


def message_lookup(spark, d):
    ev = event_messages(spark, d)
    wanted = ev.groupBy("chat", "db").agg(F.max("local_id").alias("local_id"))
    return messages.by_id(ev, wanted).select("chat", "db", "local_id", "kind")


def search_and_terms(spark, d):
    return search.search(conversation_messages(spark, d), TERMS, ["system"]).select("chat", "local_id")


def search_short_term(spark, d):
    return search.search(conversation_messages(spark, d), [SHORT]).select("chat", "local_id")


def search_sender(spark, d):
    return search.search(conversation_messages(spark, d), [], sender="SIST").select("chat", "local_id", "sender")


def search_newest(spark, d):
    return search.search(conversation_messages(spark, d), TERMS, ["system"], limit=25).select("chat", "local_id")


def search_snippet(spark, d):
    hits = search.search(conversation_messages(spark, d), TERMS, ["system"])
    return hits.select("chat", "local_id", snippet(F.col("text"), TERMS).alias("snippet"))


def search_grouped(spark, d):
    return search.grouped(search.search(conversation_messages(spark, d), TERMS, ["system"]))


def trigram_search(spark, d):
    cv = conversation_messages(spark, d)
    return search.trigram_search(cv, search.trigram_postings(cv), TERMS, ["system"]).select("chat", "local_id")


def text_cap(spark, d):
    capped = cap_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(capped).alias("n"), F.md5(capped.cast("binary")).alias("digest"))


def text_one_line(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", one_line(F.col("text"), 50).alias("line"))


def context_rows(spark, d):
    """Around the events of each chat's tenth number, which both shards may have."""
    ev = event_messages(spark, d)
    return messages.context(ev, ev.filter("local_id % 97 = 10"), 2, 2)


def context_asof(spark, d):
    ev = event_messages(spark, d)
    return messages.as_of(ev.filter("kind = 'purchase'"), ev.filter("kind = 'view'"))


def kind_counts(spark, d):
    return event_messages(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def json_extra(spark, d):
    k = F.get_json_object("extra", "$.k").cast("long")
    return event_messages(spark, d).groupBy("kind").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def day_headings(spark, d):
    return messages.with_day_headings(event_messages(spark, d)).select("chat", "db", "local_id", "day", "new_day")



def _number():
    return F.length("kind").cast("long")


def fingerprint(spark, d):
    return incremental.fingerprint(event_messages(spark, d), _number(), F.col("ts") < CURSOR)


def tail_state(spark, d):
    return incremental.tail_state(event_messages(spark, d).filter(F.col("ts") <= CURSOR))


def select_new(spark, d):
    ev = event_messages(spark, d)
    return incremental.select_new(ev, incremental.tail_state(ev.filter(F.col("ts") <= CURSOR))).select("chat", "db", "local_id")


def sync_plan(spark, d):
    ev = event_messages(spark, d)
    before = ev.filter((F.col("ts") < CURSOR) & (F.col("chat") % 5 != 0))
    now = ev.filter((F.col("chat") % 7 != 0) & ((F.col("ts") < CURSOR) | (F.col("chat") % 3 == 0))).withColumn("kind", F.when(F.col("chat") % 11 == 0, "recalled").otherwise(F.col("kind")))
    known = incremental.fingerprint(before, _number())
    upto = now.join(known.select("chat", F.col("max_id").alias("known")), "chat", "left")
    return incremental.plan_sync(known, incremental.fingerprint(now, _number()), incremental.fingerprint(upto, _number(), F.col("local_id") <= F.col("known")))


def export_totals(spark, d):
    ev = event_messages(spark, d)
    new = incremental.select_new(ev, incremental.tail_state(ev.filter(F.col("ts") <= CURSOR))).groupBy("chat").agg(F.count(F.lit(1)).alias("n"))
    return incremental.export_totals(new)


def manifest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.col("o_totalprice").cast("long").alias("size"))
    before = o.filter("cast(path as long) % 3 <> 0")
    now = o.filter("cast(path as long) % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("path").cast("long") % 7 == 0, 1).otherwise(0))
    return incremental.manifest_status(before, now)


def run_log_last(spark, d):
    o = table(spark, d, "orders")
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("job")).agg(last.alias("v"), F.count(F.lit(1)).alias("runs")).select("job", F.col("v.o_orderkey").alias("run"), F.col("v.o_orderstatus").alias("status"), "runs")


QUERIES = {f.__name__: f for f in (
    page_backward, page_forward, page_from_start, page_last, page_has_more, time_range_inclusive, time_range_halfopen, message_lookup, search_and_terms,
    search_short_term, search_sender, search_newest, search_snippet, search_grouped, trigram_search, text_cap, text_one_line, context_rows, context_asof,
    kind_counts, json_extra, day_headings, fingerprint, tail_state, select_new, sync_plan, export_totals, manifest, run_log_last,
)}

_RN = "row_number() OVER (PARTITION BY chat ORDER BY ts, dbr, local_id) AS rn"
_HITS = f"WITH {CV}, hits AS (SELECT * FROM cv WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND kind <> 'system')"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _page(where: str, way: str) -> str:
    order = ", ".join(f"{c} {way}" for c in ("ts", "dbr", "local_id"))
    return f"""WITH {EV}, p AS (SELECT * FROM ev {where} QUALIFY row_number() OVER (PARTITION BY chat ORDER BY {order}) <= 10)
      SELECT chat, {_RN}, db, local_id, ts, kind FROM p"""


_FP = "count(*) FILTER (ok) AS cnt, max(local_id) FILTER (ok) AS max_id, CAST(coalesce(sum(length(kind)) FILTER (ok), 0) AS BIGINT) AS type_sum"
_TAIL = f"tail AS (SELECT chat, ts AS last_ts, count(*) AS n_last FROM ev WHERE ts <= {CURSOR} GROUP BY chat, ts QUALIFY ts = max(ts) OVER (PARTITION BY chat))"
_NEW = f"""WITH {EV}, {_TAIL}, placed AS (SELECT *, row_number() OVER (PARTITION BY chat, ts ORDER BY dbr, local_id) AS nth FROM ev),
  fresh AS (SELECT p.chat, p.db, p.local_id FROM placed p LEFT JOIN tail t ON p.chat = t.chat WHERE t.chat IS NULL OR p.ts > last_ts OR (p.ts = last_ts AND nth > n_last))"""

ORACLES = {
    "page_backward": _page(f"WHERE ts < {CURSOR}", "DESC"),
    "page_forward": _page(f"WHERE ts >= {CURSOR} AND (ts, dbr, local_id) > ({CURSOR}, 0, 0)", "ASC"),
    "page_from_start": _page("", "ASC"),
    "page_last": _page("", "DESC"),
    "page_has_more": f"""WITH {EV}, r AS (SELECT * FROM ev WHERE ts BETWEEN {SINCE} AND {UNTIL}), n AS (SELECT *, {_RN}, count(*) OVER (PARTITION BY chat) AS total FROM r),
      p AS (SELECT * FROM n WHERE ts < {CURSOR} QUALIFY row_number() OVER (PARTITION BY chat ORDER BY rn DESC) <= 5)
      SELECT chat, min(rn) > 1 AS has_more_before, max(rn) < min(total) AS has_more_after FROM p GROUP BY chat""",
    "time_range_inclusive": f"WITH {EV} SELECT chat, count(*) AS n FROM ev WHERE ts >= {SINCE} AND ts <= {UNTIL} GROUP BY chat",
    "time_range_halfopen": f"WITH {EV} SELECT chat, count(*) AS n FROM ev WHERE ts >= {SINCE} AND ts < {UNTIL} GROUP BY chat",
    "message_lookup": f"WITH {EV} SELECT chat, db, local_id, kind FROM ev QUALIFY local_id = max(local_id) OVER (PARTITION BY chat, db)",
    "search_and_terms": f"{_HITS} SELECT chat, local_id FROM hits",
    "search_short_term": f"WITH {CV} SELECT chat, local_id FROM cv WHERE contains(lower(text), 'th')",
    "search_sender": f"WITH {CV} SELECT chat, local_id, sender FROM cv WHERE contains(lower(sender), 'sist')",
    "search_newest": f"{_HITS} SELECT chat, local_id FROM hits ORDER BY ts DESC, dbr DESC, local_id DESC, chat LIMIT 25",
    "search_snippet": f"""{_HITS}, g AS (SELECT chat, local_id, text, length(text) AS n, instr(lower(text), 'the') - 1 AS seat FROM hits)
      SELECT chat, local_id, CASE WHEN n <= 140 THEN text ELSE CASE WHEN seat > 60 THEN '…' ELSE '' END || substr(text, greatest(seat - 60, 0) + 1, least(seat + 60, n) - greatest(seat - 60, 0))
        || CASE WHEN seat + 60 < n THEN '…' ELSE '' END END AS snippet FROM g""",
    "search_grouped": f"{_HITS} SELECT chat, count(*) AS n, string_agg(CAST(local_id AS VARCHAR), ',' ORDER BY ts DESC, local_id DESC) AS ids FROM hits GROUP BY chat",
    "trigram_search": f"{_HITS} SELECT chat, local_id FROM hits",
    "text_cap": """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…[+' || (length(text) - 4000) || ' chars]' ELSE text END AS t FROM documents)
      SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c""",
    "text_one_line": f"""WITH f AS (SELECT conv_id, turn, coalesce({_FLAT}, '') AS s FROM conversations)
      SELECT conv_id, turn, CASE WHEN length(s) > 50 THEN rtrim(substr(s, 1, 50)) || '…' ELSE s END AS line FROM f""",
    "context_rows": f"""WITH {EV}, p AS (SELECT *, {_RN} FROM ev), a AS (SELECT DISTINCT chat, db AS anchor_db, local_id AS anchor, rn AS rn0 FROM p WHERE local_id % 97 = 10)
      SELECT a.chat, anchor_db, anchor, p.db, p.local_id, p.rn - rn0 AS distance FROM a JOIN p ON a.chat = p.chat AND p.rn BETWEEN rn0 - 2 AND rn0 + 2""",
    "context_asof": f"""WITH {EV}, v AS (SELECT chat, ts, dbr, local_id FROM ev WHERE kind = 'view'), p AS (SELECT chat, ts, dbr, local_id FROM ev WHERE kind = 'purchase'),
      x AS (SELECT p.chat, p.dbr, p.local_id, (SELECT max((v.ts, v.dbr, v.local_id)) FROM v WHERE v.chat = p.chat AND v.ts <= p.ts) AS b,
        (SELECT min((v.ts, v.dbr, v.local_id)) FROM v WHERE v.chat = p.chat AND v.ts > p.ts) AS f FROM p)
      SELECT chat, dbr, local_id, coalesce(b, f)[2] AS target_dbr, coalesce(b, f)[3] AS target_id, b IS NULL AS fell_forward FROM x""",
    "kind_counts": f"WITH {EV} SELECT kind, count(*) AS n FROM ev GROUP BY kind",
    "json_extra": f"WITH {EV} SELECT kind, CAST(sum(CAST(extra->>'$.k' AS BIGINT)) AS BIGINT) AS total, count(extra->>'$.k') AS n FROM ev GROUP BY kind",
    "day_headings": f"""WITH {EV}, x AS (SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM ev)
      SELECT chat, db, local_id, day, coalesce(day <> lag(day) OVER (PARTITION BY chat ORDER BY ts, dbr, local_id), true) AS new_day FROM x""",
    "fingerprint": f"WITH {EV}, x AS (SELECT *, ts < {CURSOR} AS ok FROM ev) SELECT chat, {_FP} FROM x GROUP BY chat",
    "tail_state": f"WITH {EV}, {_TAIL} SELECT chat, last_ts, n_last FROM tail",
    "select_new": f"{_NEW} SELECT chat, db, local_id FROM fresh",
    "sync_plan": f"""WITH {EV}, b AS (SELECT *, true AS ok FROM ev WHERE ts < {CURSOR} AND chat % 5 <> 0),
      n AS (SELECT chat, ts, db, local_id, CASE WHEN chat % 11 = 0 THEN 'recalled' ELSE kind END AS kind, true AS ok FROM ev WHERE chat % 7 <> 0 AND (ts < {CURSOR} OR chat % 3 = 0)),
      p AS (SELECT chat, {_FP} FROM b GROUP BY chat), c AS (SELECT chat, {_FP} FROM n GROUP BY chat),
      u AS (SELECT n.chat, n.local_id, n.kind, n.local_id <= p.max_id AS ok FROM n LEFT JOIN p ON n.chat = p.chat), x AS (SELECT chat, {_FP} FROM u GROUP BY chat)
      SELECT coalesce(p.chat, c.chat) AS chat, CASE WHEN c.chat IS NULL THEN 'drop' WHEN p.chat IS NULL THEN 'rebuild'
        WHEN (p.cnt, p.max_id, p.type_sum) = (c.cnt, c.max_id, c.type_sum) THEN 'skip' WHEN (p.cnt, p.max_id, p.type_sum) = (x.cnt, x.max_id, x.type_sum) THEN 'append'
        ELSE 'rebuild' END AS action FROM p FULL JOIN c ON p.chat = c.chat LEFT JOIN x ON x.chat = c.chat""",
    "export_totals": f"{_NEW}, t AS (SELECT chat, count(*) AS n FROM fresh GROUP BY chat) SELECT count(*) FILTER (n > 0) AS changed_chats, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_new FROM t",
    "manifest": """WITH o AS (SELECT o_orderkey AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders),
      b AS (SELECT * FROM o WHERE k % 3 <> 0), n AS (SELECT k, mtime, size + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS size FROM o WHERE k % 5 <> 0)
      SELECT CAST(coalesce(b.k, n.k) AS VARCHAR) AS path, CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'missing'
        WHEN b.mtime = n.mtime AND b.size = n.size THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN n ON b.k = n.k""",
    "run_log_last": """SELECT o_custkey AS job, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS runs
      FROM orders GROUP BY o_custkey""",
}
