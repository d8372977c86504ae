"""Chat lists, name resolution and visibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.scalars import match_rank, pick_name, table_name_for

# Usernames of accounts that are services.
SYSTEM_USERNAMES = (
    "appbrand_notify_message", "blogapp", "brandservicesessionholder", "brandsessionholder", "cardpackage", "chatroom_notify", "downloaderapp", "exmail_tool",
    "facebookapp", "feedsapp", "filehelper", "floatbottle", "fmessage", "gamecenter", "googlecontact", "helper_entry", "lbsapp", "linkedinplugin",
    "masssendapp", "medianote", "mphelper", "newsapp", "notification_messages", "notifymessage", "officialaccounts", "opencustomerservicemsg", "qmessage",
    "qqmail", "qqsync", "shakeapp", "tmessage", "userexperience_alarm", "voicevoipapp", "voiceinputapp", "voip", "voipmsg",
    "weixin", "@placeholder_foldgroup",
)


def list_chats(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """(chat, msg_count, last_ts), the newest chat first; raw rows count, whatever their text."""
    out = messages.groupBy("chat").agg(F.count(F.lit(1)).alias("msg_count"), F.max("ts").alias("last_ts"))
    return out if limit is None else out.orderBy(F.col("last_ts").desc(), "chat").limit(limit)


def list_footer(chats: DataFrame, is_group: Column) -> DataFrame:
    """(is_group, n): chats by class, and with a null class all of them."""
    return chats.select(is_group.alias("is_group")).rollup("is_group").agg(F.count(F.lit(1)).alias("n"))


def is_group_name(username: Column) -> Column:
    return F.endswith(username, F.lit("@chatroom"))


def is_not_a_person(username: Column, verify_flag: Column, more: Sequence[str] = (), person_prefix: str = "wxid_") -> Column:
    """Accounts that are services: official ones, the built-in ones and ``more``, and verified ones whose name isn't a person's or a room's."""
    verified = (F.coalesce(verify_flag, F.lit(0)) != 0) & ~F.startswith(username, F.lit(person_prefix)) & ~F.contains(username, F.lit("@"))
    return F.startswith(username, F.lit("gh_")) | username.isin(*SYSTEM_USERNAMES, *more) | F.startswith(username, F.lit("@")) | verified


def with_names(chats: DataFrame, names: Column) -> DataFrame:
    """``chats`` with the distinct non-empty names they are known by."""
    return chats.withColumn("names", F.filter(F.array_distinct(names), lambda n: n.isNotNull() & (n != "")))


def filter_by_name(chats: DataFrame, text: str) -> DataFrame:
    return chats.filter(F.exists("names", lambda n: F.contains(F.lower(n), F.lit(text.lower()))))


def _grams(text: Column, size: Column) -> Column:
    """The distinct parts of ``text`` that are ``size`` characters long."""
    parts = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.array_distinct(F.when(F.length(text) >= size, parts).otherwise(F.array().cast("array<string>")))


#: Bytes of patterns, or of their grams, that are sent to every task; more of them meet the names in a shuffle.
SENT_BYTES = 4_000_000


def _way(few: DataFrame, *columns: str) -> str:
    """How ``few`` meets a larger table: sent to every task if it is small, else in a shuffle; the larger side is never broadcast."""
    size = few.agg(F.sum(reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns]))).first()[0] or 0
    return "broadcast" if size <= SENT_BYTES else "merge"


def part_matches(names: DataFrame, patterns: DataFrame, keys_too: bool = False) -> DataFrame:
    """(pattern, key, name) where the name, or as text the key, can have the pattern as a part: it has the pattern's rarest trigram.

    Names and patterns meet by equal grams, of three characters or all a shorter pattern has, so neither side is
    compared with all of the other. Grams are counted first; what is found by the rarest is still to be verified.
    The names' grams are never broadcast, though the planner takes them for as small as the names: the patterns' are, if they are few.
    """
    key = F.col("key").cast("string")
    texts = [("name", F.lower("name"))] + ([("key", F.lower(key))] if keys_too else [])
    low = F.lower("pattern")
    asked = patterns.select("pattern").distinct().filter("pattern <> ''").withColumn("_grams", _grams(low, F.least(F.length(low), F.lit(3))))
    asked = asked.select("pattern", F.explode("_grams").alias("gram"))
    way = _way(asked, "pattern", "gram")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), t.alias("text")) for side, t in texts]))
    # Parts of three characters and less from each place; at a text's end they are shorter ones, which it has too.
    rows = names.select("key", "name", sides.alias("t")).select("key", "name", "t.side", "t.text").filter("text <> ''")
    places = rows.select("key", "name", "side", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("_at"))
    held = places.select("key", "name", "side", F.explode(F.array(*[F.substring(F.col("text"), F.col("_at"), F.lit(n)) for n in (1, 2, 3)])).alias("gram"))
    rare = held.join(asked.hint(way), "gram").groupBy("pattern", "gram").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return held.join(rare.hint(way), "gram").select("pattern", "key", "name").distinct()  # ``rare`` has at most the grams of ``asked``


def ranked_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, key, name, rank) of the chats that match by name or, as text, by key; the better of the two ranks counts.

    Names meet patterns by grams (``part_matches``).
    """
    key = F.col("key").cast("string")
    best = F.least(match_rank(F.col("name"), F.col("pattern")), match_rank(key, F.col("pattern")))
    return part_matches(names, patterns, keys_too=True).select("pattern", "key", "name", best.alias("rank")).filter("rank is not null")


def resolve(names: DataFrame, patterns: DataFrame, candidates: int = 20) -> DataFrame:
    """(pattern, key, name, rank, ambiguous): an equal key if there is one, else the matches of each pattern's best rank by name, ``candidates`` of them at most.

    ``key`` is the username; ranks are -1 for an equal key, 0 for an equal name, 1 but for case, 2 for a part of it.
    """
    key = F.col("key").cast("string")
    equal = names.select("key", "name").join(patterns.select("pattern").hint(_way(patterns, "pattern")), key == F.col("pattern")).select("pattern", "key", "name")
    rank = F.when(key == F.col("pattern"), -1).otherwise(match_rank(F.col("name"), F.col("pattern")))
    found = equal.unionByName(part_matches(names, patterns)).distinct().select("pattern", "key", "name", rank.alias("rank")).filter("rank is not null")
    # The first rows by rank tell the best rank and whether two have it; tasks keep no more than those of a pattern.
    w = Window.partitionBy("pattern")
    first = found.withColumn("nth", F.row_number().over(w.orderBy("rank", "name", "key"))).filter(F.col("nth") <= max(candidates, 2))
    ranked = first.withColumn("best", F.min("rank").over(w)).withColumn("ambiguous", F.count_if(F.col("rank") == F.col("best")).over(w) > 1).filter("rank = best")
    return ranked.filter(F.col("nth") <= candidates).select("pattern", "key", "name", "rank", "ambiguous")


def override(contacts: DataFrame, prefer: str = "contact") -> DataFrame:
    """One row for each key; a contact stands before a stranger, then the smaller name."""
    w = Window.partitionBy("key").orderBy(F.when(F.col("source") == prefer, 0).otherwise(1), "nick_name")
    return contacts.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def display_names(contacts: DataFrame) -> DataFrame:
    """(key, display): remark, else nickname, else the key."""
    return override(contacts).select("key", pick_name(F.col("key").cast("string"), F.col("remark"), F.col("nick_name")).alias("display"))


def by_table_hash(tables: DataFrame, usernames: DataFrame) -> DataFrame:
    """Message tables with the username that their name is the hash of; others drop out."""
    return tables.join(usernames.withColumn("tbl", table_name_for(F.col("username"))), "tbl")


def hidden_by_block(chats: DataFrame, blocked: DataFrame) -> DataFrame:
    """``chats`` without those that any blocked name names."""
    gone = chats.select("chat", F.explode("names").alias("name")).join(blocked, "name", "left_semi").select("chat").distinct()
    return chats.join(gone, "chat", "left_anti")


def visible_by_allow(chats: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only those of ``chats`` that an allowed name names."""
    kept = chats.select("chat", F.explode("names").alias("name")).join(allowed, "name", "left_semi").select("chat").distinct()
    return chats.join(kept, "chat", "left_semi")


def all_related_visible(related: DataFrame, hidden: DataFrame) -> DataFrame:
    """Items (item) none of whose related people (person) is hidden."""
    bad = related.join(hidden, "person", "left_semi").select("item").distinct()
    return related.select("item").distinct().join(bad, "item", "left_anti")


def duplicate_names(names: DataFrame) -> DataFrame:
    """(name, n) of the display names that several have."""
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_sender_names(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``messages`` (db, real_sender_id) with ``sender_user`` from the shard's dictionary (db, id, user_name); null where it has no such id, '' for the system."""
    d = dictionary.select("db", F.col("id").alias("real_sender_id"), F.coalesce("user_name", F.lit("")).alias("sender_user"))
    return messages.join(d, ["db", "real_sender_id"], "left")


def with_display(messages: DataFrame, contacts: DataFrame, nicknames: DataFrame, own: str, own_name: str = "我", system_name: str = "系统") -> DataFrame:
    """``messages`` (chat, sender_user, real_sender_id) with ``sender`` and ``is_self``.

    Oneself, then the system for an empty name, in a group the nickname there, the contact's
    name, the username; an unknown id as such. ``contacts`` has username, display; ``nicknames`` chat, username, nick.
    """
    # A username that is there twice, as a contact and a stranger say, must not double its messages; ``source`` tells which stands.
    place = F.when(F.col("source") == "contact", 0).otherwise(1) if "source" in contacts.columns else F.lit(0)
    c = contacts.groupBy(F.col("username").alias("sender_user")).agg(F.min(F.struct(place.alias("p"), F.col("display").alias("display")))["display"].alias("display"))
    n = nicknames.filter(F.coalesce("nick", F.lit("")) != "").groupBy("chat", F.col("username").alias("sender_user")).agg(F.min("nick").alias("nick"))
    rows = messages.join(c, "sender_user", "left").join(n, ["chat", "sender_user"], "left")
    user = F.col("sender_user")
    unknown = F.concat(F.lit("未知("), F.col("real_sender_id").cast("string"), F.lit(")"))
    shown = F.coalesce(F.when(is_group_name(F.col("chat")), F.col("nick")), F.col("display"), user)
    name = F.when(user.isNull(), unknown).when(user == own, own_name).when(user == "", system_name).otherwise(shown)
    return rows.withColumns({"sender": name, "is_self": F.coalesce(user == own, F.lit(False))}).drop("display", "nick")
