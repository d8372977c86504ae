"""Chat lists, resolution, visibility, rooms and profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.scalars import safe_filename, safe_url, url_host
from chatlake.operators import chats, messages, rooms
from chatlake.session import table
from chatlake.sources.tables import contact_rows, conversation_messages, event_messages, room_members

EV = "ev AS (SELECT user_id AS chat, CAST(event_id % 2 AS INT) AS db, -CAST(event_id % 2 AS INT) AS dbr, event_id // 2 AS local_id, event_id * 10 AS server_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS kind, value, props AS extra FROM events)"
CV = "cv AS (SELECT conv_id AS chat, 0 AS db, 0 AS dbr, turn AS local_id, turn AS ts, role AS sender, role = 'user' AS is_self, CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS kind, text FROM conversations)"
PATTERNS = ["Customer#000000012", "customer#000000099", "00000001", "Customer#000000900", "nobody", "12"]


def _patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


def _names(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


def list_chats(spark, d):
    return chats.list_chats(event_messages(spark, d))


def list_chats_top(spark, d):
    return chats.list_chats(event_messages(spark, d), 20)


def list_chats_footer(spark, d):
    return chats.list_footer(event_messages(spark, d).select("chat").distinct(), F.col("chat") % 2 == 0)


def chat_type_filter(spark, d):
    return chats.list_chats(event_messages(spark, d).filter(F.col("chat") % 2 == 0))


def find_chats_ranked(spark, d):
    return chats.ranked_matches(_names(spark, d), _patterns(spark))


def resolve_ladder(spark, d):
    return chats.resolve(_names(spark, d), _patterns(spark))


def contact_override(spark, d):
    return chats.override(contact_rows(spark, d)).select("key", "source", "nick_name")


def name_cascade(spark, d):
    people = contact_rows(spark, d).withColumn("remark", F.when(F.col("key") % 3 == 0, "  ").otherwise(F.col("remark"))).withColumn("nick_name", F.when(F.col("key") % 6 == 0, "").otherwise(F.col("nick_name")))
    return chats.display_names(people)


def name_filter(spark, d):
    named = chats.with_names(_names(spark, d).select(F.col("key").alias("chat"), "name"), F.array("name", F.lit(""), F.col("name")))
    return chats.filter_by_name(named, "CUSTOMER#0000001").select("chat", F.element_at("names", 1).alias("name"), F.size("names").alias("n_names"))


def sender_dictionary_join(spark, d):
    """Each shard has a dictionary of its own: the same number is another person there, or nobody."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("user_name"))
    ids = c.filter("id % 2 = 1").withColumn("db", F.lit(0)).unionByName(c.filter("id % 3 = 1").withColumns({"db": F.lit(1), "user_name": F.when(F.col("id") % 4 == 0, "").otherwise(F.concat("user_name", F.lit("@1")))}))
    named = chats.with_sender_names(event_messages(spark, d).withColumn("real_sender_id", F.col("chat")), ids)
    return named.select("server_id", "db", "sender_user")


def table_hash_join(spark, d):
    tables = event_messages(spark, d).groupBy("chat").agg(F.count(F.lit(1)).alias("n")).select(chats.table_name_for(F.col("chat")).alias("tbl"), "n")
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("username")).filter("username % 2 = 0")
    return chats.by_table_hash(tables, known).select("tbl", "username", "n")


def _named_events(spark, d):
    c = _names(spark, d).join(event_messages(spark, d).select("chat").distinct(), F.col("key") == F.col("chat"))
    return chats.with_names(c.select("chat", "name"), F.array("name", F.concat(F.lit("seg"), (F.col("chat") % 7).cast("string"))))


def _policy(spark):
    return spark.createDataFrame([("Customer#000000005",), ("seg3",), ("nobody",)], "name string")


def policy_block(spark, d):
    return chats.hidden_by_block(_named_events(spark, d), _policy(spark)).select("chat")


def policy_allow(spark, d):
    return chats.visible_by_allow(_named_events(spark, d), _policy(spark)).select("chat")


def policy_all_related(spark, d):
    related = room_members(spark, d).select(F.col("room").alias("item"), F.col("member").alias("person"))
    hidden = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("person"))
    return chats.all_related_visible(related, hidden)


def shared_rooms(spark, d):
    activity = table(spark, d, "orders").select(F.col("o_orderkey").alias("room"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("last_ts"))
    return rooms.shared_rooms(room_members(spark, d), activity, 5)


def room_first_members(spark, d):
    return rooms.first_members(room_members(spark, d), 3)


def unnamed_room_name(spark, d):
    """Suppliers of the first nation are oneself, so that some rooms have nobody else; others are known by their names, if they have an even number."""
    names = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("member"), F.col("s_name").alias("display"))
    return rooms.unnamed_room_names(room_members(spark, d), F.col("member") % 5 == 0, names)


def member_count(spark, d):
    return rooms.member_counts(room_members(spark, d))


def chat_profile(spark, d):
    return messages.profile(conversation_messages(spark, d))


def dup_names(spark, d):
    return chats.duplicate_names(table(spark, d, "part").select(F.col("p_name").alias("name")))


def safe_url_host(spark, d):
    return table(spark, d, "pages").select("page_id", safe_url(F.col("url")).alias("safe_url"), url_host(F.col("url")).alias("host"))


def filename_of_url(spark, d):
    return table(spark, d, "pages").select("page_id", safe_filename(F.concat(F.lit(" . \x7f"), "url", F.lit(".. ")), 40).alias("filename"), safe_filename(F.regexp_replace("url", "[^.]", ""), fallback=F.lit("none")).alias("dots"))


QUERIES = {f.__name__: f for f in (
    list_chats, list_chats_top, list_chats_footer, chat_type_filter, find_chats_ranked, resolve_ladder, contact_override, name_cascade, name_filter,
    sender_dictionary_join, table_hash_join, policy_block, policy_allow, policy_all_related, shared_rooms, room_first_members, unnamed_room_name,
    member_count, chat_profile, dup_names, safe_url_host, filename_of_url,
)}

_P = "(VALUES ('" + "'), ('".join(PATTERNS) + "')) AS p(pattern)"
_RANKED = f"""ranked AS (SELECT pattern, c_custkey AS key, c_name AS name,
  CASE WHEN c_name = pattern OR CAST(c_custkey AS VARCHAR) = pattern THEN 0 WHEN lower(c_name) = lower(pattern) THEN 1 ELSE 2 END AS rank
  FROM customer, {_P} WHERE contains(lower(c_name), lower(pattern)) OR contains(CAST(c_custkey AS VARCHAR), pattern))"""
_LADDER = f"""ladder AS (SELECT pattern, c_custkey AS key, c_name AS name,
  CASE WHEN CAST(c_custkey AS VARCHAR) = pattern THEN -1 WHEN c_name = pattern THEN 0 WHEN lower(c_name) = lower(pattern) THEN 1 ELSE 2 END AS rank
  FROM customer, {_P} WHERE contains(lower(c_name), lower(pattern)) OR CAST(c_custkey AS VARCHAR) = pattern)"""
_MEMBERS = "m AS (SELECT l_orderkey AS room, l_linenumber AS pos, l_suppkey AS member FROM lineitem)"
_CONTACTS = """c AS (SELECT c_custkey AS key, 'contact' AS source, c_name AS nick_name, c_mktsegment AS remark FROM customer
  UNION ALL SELECT s_suppkey, 'stranger', s_name, '' FROM supplier)"""
_ONE = "one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN source = 'contact' THEN 0 ELSE 1 END, nick_name) = 1)"
_NAMED = "named AS (SELECT DISTINCT c_custkey AS chat, c_name AS n1, 'seg' || (c_custkey % 7) AS n2 FROM customer JOIN events ON c_custkey = user_id)"
_POLICY = "('Customer#000000005', 'seg3', 'nobody')"

ORACLES = {
    "list_chats": f"WITH {EV} SELECT chat, count(*) AS msg_count, max(ts) AS last_ts FROM ev GROUP BY chat",
    "list_chats_top": f"WITH {EV} SELECT chat, count(*) AS msg_count, max(ts) AS last_ts FROM ev GROUP BY chat ORDER BY last_ts DESC, chat LIMIT 20",
    "list_chats_footer": f"WITH {EV}, c AS (SELECT DISTINCT chat, chat % 2 = 0 AS is_group FROM ev) SELECT is_group, count(*) AS n FROM c GROUP BY ROLLUP (is_group)",
    "chat_type_filter": f"WITH {EV} SELECT chat, count(*) AS msg_count, max(ts) AS last_ts FROM ev WHERE chat % 2 = 0 GROUP BY chat",
    "find_chats_ranked": f"WITH {_RANKED} SELECT pattern, key, name, rank FROM ranked",
    "resolve_ladder": f"""WITH {_LADDER}, best AS (SELECT * FROM ladder QUALIFY rank = min(rank) OVER (PARTITION BY pattern)),
      x AS (SELECT *, count(*) OVER (PARTITION BY pattern) > 1 AS ambiguous, row_number() OVER (PARTITION BY pattern ORDER BY name, key) AS nth FROM best)
      SELECT pattern, key, name, rank, ambiguous FROM x WHERE nth <= 20""",
    "contact_override": f"WITH {_CONTACTS}, {_ONE} SELECT key, source, nick_name FROM one",
    "name_cascade": f"""WITH {_CONTACTS}, {_ONE} SELECT key, coalesce(nullif(trim(CASE WHEN key % 3 = 0 THEN '  ' ELSE remark END), ''),
      nullif(trim(CASE WHEN key % 6 = 0 THEN '' ELSE nick_name END), ''), CAST(key AS VARCHAR)) AS display FROM one""",
    "name_filter": "SELECT c_custkey AS chat, c_name AS name, 1 AS n_names FROM customer WHERE contains(lower(c_name), 'customer#0000001')",
    "sender_dictionary_join": """SELECT event_id * 10 AS server_id, CAST(event_id % 2 AS INT) AS db, CASE WHEN event_id % 2 = 0 THEN CASE WHEN user_id % 2 = 1 THEN c_name END
      WHEN user_id % 3 = 1 AND c_custkey IS NOT NULL THEN CASE WHEN user_id % 4 = 0 THEN '' ELSE c_name || '@1' END END AS sender_user FROM events LEFT JOIN customer ON user_id = c_custkey""",
    "table_hash_join": "SELECT 'Msg_' || md5(CAST(user_id AS VARCHAR)) AS tbl, user_id AS username, count(*) AS n FROM events WHERE user_id % 2 = 0 AND user_id IN (SELECT c_custkey FROM customer) GROUP BY ALL",
    "policy_block": f"WITH {_NAMED} SELECT chat FROM named WHERE n1 NOT IN {_POLICY} AND n2 NOT IN {_POLICY}",
    "policy_allow": f"WITH {_NAMED} SELECT chat FROM named WHERE n1 IN {_POLICY} OR n2 IN {_POLICY}",
    "policy_all_related": "SELECT DISTINCT l_orderkey AS item FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0)",
    "shared_rooms": f"""WITH {_MEMBERS}, s AS (SELECT room, count(DISTINCT member) AS member_count FROM m GROUP BY room),
      x AS (SELECT DISTINCT member, room FROM m), y AS (SELECT member, x.room, member_count, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS last_ts
      FROM x JOIN s ON x.room = s.room LEFT JOIN orders ON o_orderkey = x.room)
      SELECT member, room, member_count, last_ts, row_number() OVER (PARTITION BY member ORDER BY last_ts DESC NULLS LAST, room) AS nth FROM y QUALIFY nth <= 5""",
    "room_first_members": f"WITH {_MEMBERS} SELECT room, row_number() OVER (PARTITION BY room ORDER BY pos, member) AS nth, member FROM m QUALIFY nth <= 3",
    "unnamed_room_name": f"""WITH {_MEMBERS}, r AS (SELECT room, pos, member, CASE WHEN member % 2 = 0 THEN s_name ELSE CAST(member AS VARCHAR) END AS shown,
        row_number() OVER (PARTITION BY room ORDER BY pos, member) AS nth FROM m LEFT JOIN supplier ON s_suppkey = member WHERE member % 5 <> 0)
      SELECT room, string_agg(shown, '、' ORDER BY nth) FILTER (nth <= 3) || CASE WHEN count(*) > 3 THEN '等' || (count(*) + 1) || '人' ELSE '' END AS name FROM r GROUP BY room""",
    "member_count": f"WITH {_MEMBERS} SELECT room, count(DISTINCT member) AS member_count FROM m GROUP BY room",
    "chat_profile": f"""WITH {CV} SELECT chat, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (is_self) AS sent_by_me,
      count(*) - count(*) FILTER (is_self) AS sent_by_them FROM cv GROUP BY chat""",
    "dup_names": "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "safe_url_host": """SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url END AS safe_url,
      CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) END AS host FROM pages""",
    "filename_of_url": r"""SELECT page_id, substr('_' || regexp_replace(url, '[\\/:*?"<>|\x00-\x1f\x7f]', '_', 'g'), 1, 40) AS filename, 'none' AS dots FROM pages""",
}
