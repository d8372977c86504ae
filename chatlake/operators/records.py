"""Messages as records: decoded, with sender, display name, kind, text and their place in the chat, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.decoders import decode_content
from chatlake.operators import chats, enrich
from chatlake.operators.messages import in_record_order

KEY = ("chat", "db", "local_id")
#: Where usernames stand in a message's XML: in elements and attributes whose names end so.
NAMED = r'(?i)(?:username|usr)(?:>\s*(?:<!\[CDATA\[)?|\s*=\s*")\s*([A-Za-z0-9_\-@.]+)'


def media_seconds(content: Column, kind: Column) -> Column:
    """Whole seconds, one at least, of a voice (``voicelength`` in thousandths) or video (``playlength``) message; null without a positive number."""
    of = lambda name: F.regexp_extract(content, rf'{name}\s*=\s*"\s*(\d+(?:\.\d+)?)\s*"', 1).try_cast("double")
    s = F.when(kind == "voice", of("voicelength") / 1000).when(kind == "video", of("playlength"))
    return F.when(s > 0, F.greatest(F.lit(1), F.floor(s + 0.5)).cast("long"))


def local_names(messages: DataFrame, names: DataFrame, content: Column) -> DataFrame:
    """``messages`` with ``_names``, a map of the usernames in its own XML to the names (username, display) they have: a join, whatever the number of people."""
    found = messages.select(*KEY, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(NAMED), 1))).alias("username"))
    known = found.join(names.groupBy("username").agg(F.min_by("display", "place").alias("display") if "place" in names.columns else F.min("display").alias("display")), "username")
    # One message's names: at most what one message mentions.
    own = known.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("username", "display"))).alias("_names"))
    return messages.join(own, list(KEY), "left").withColumn("_names", F.coalesce("_names", F.create_map().cast("map<string,string>")))


def message_records(raw: DataFrame, dictionary: DataFrame, contacts: DataFrame, nicknames: DataFrame, own: str) -> DataFrame:
    """Records of rows (chat, db, local_id, server_id, local_type, sort_seq, real_sender_id, create_time, content, ct, packed_info).

    The sender is what the shard's dictionary says, else in a group what the message's prefix says, unless that is the
    group, else what its XML says, but for system messages. One's own messages keep a line that looks like a prefix.
    ``packed`` is there for images and videos only, ``seconds`` for voices and videos. Rows without text drop out.
    """
    rows = raw.withColumn("content", decode_content(F.col("content"), F.col("ct"))).drop("ct").withColumn("ts", F.coalesce("create_time", F.lit(0)))
    rows = chats.with_sender_names(rows, dictionary)
    group, sender, content = chats.is_group_name(F.col("chat")), F.col("sender_user"), F.col("content")
    prefix = enrich.prefix_sender(content)
    strip = group & prefix.isNotNull() & ~sender.eqNullSafe(F.lit(own))
    empty = F.coalesce(sender, F.lit("")) == ""
    named = F.when(strip & empty & (prefix != F.col("chat")), prefix).otherwise(sender)
    rows = rows.withColumns({"_named": named, "content": F.when(strip, enrich.strip_prefix(content)).otherwise(content)})
    low = F.col("local_type").bitwiseAND(F.lit(4294967295))
    still = F.coalesce("_named", F.lit("")) == ""
    rows = rows.withColumn("sender_user", F.when(group & still & (low != 10000), F.coalesce(enrich.sender_in_xml(F.col("content")), F.col("_named"))).otherwise(F.col("_named"))).drop("_named")
    # Oneself is 我, whatever one's own contact says.
    shown = contacts.select("username", "display", F.lit(1).alias("place")).unionByName(raw.sparkSession.createDataFrame([(own, "我", 0)], "username string, display string, place int"))
    rows = chats.with_display(local_names(rows, shown, F.col("content")), contacts, nicknames, own)
    done = enrich.enrich_messages(rows, prefixed=False)
    out = done.withColumns(
        {"seconds": media_seconds(F.col("content"), F.col("kind")), "packed": F.when(F.col("base").isin(3, 43), F.col("packed_info")), "server_id": F.nullif(F.col("server_id"), F.lit(0))}
    )
    return in_record_order(out.drop("_names", "packed_info"))
