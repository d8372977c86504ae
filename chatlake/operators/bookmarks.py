"""Bookmarks: from XML to records, tags, search and visibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from chatlake.functions.decoders import decode_blob
from chatlake.functions.scalars import first_filled, to_double, to_long
from chatlake.operators.enrich import lookup
from chatlake.operators.feed import clean_xml

# Fixed values of the bookmark format.
KINDS = {
    1: "text", 2: "image", 3: "voice", 4: "video", 5: "link", 6: "location", 7: "music", 8: "file", 10: "product", 12: "tv", 14: "chat_record", 16: "video",
    17: "chat_record", 18: "note", 19: "miniprogram", 20: "channels",
}
SOURCE = "_sourcetype: STRING, fromusr: STRING, tousr: STRING, realchatname: STRING, createtime: STRING, msgid: STRING, link: STRING"
ITEM = f"_datatype: STRING, datatitle: STRING, datadesc: STRING, datafmt: STRING, fullsize: STRING, datasize: STRING, fullmd5: STRING, thumbfullmd5: STRING, stream_weburl: STRING, weburl: STRING, datasrcname: STRING, dataitemsource: STRUCT<{SOURCE}>"
BOOKMARK = f"""favitem STRUCT<_type: STRING, title: STRING, desc: STRING, source: STRUCT<{SOURCE}>, datalist: STRUCT<dataitem: ARRAY<STRUCT<{ITEM}>>>,
  weburlitem: STRUCT<pagetitle: STRING, pagedesc: STRING, clean_url: STRING>, locitem: STRUCT<lat: STRING, lng: STRING, label: STRING, poiname: STRING>, taglist: STRUCT<tag: ARRAY<STRING>>>"""


def load_bookmarks(raw: DataFrame, bound: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """Parsed bookmarks, with the tags bound to them (id, tag), and what the same reading counts: rows, parsed, failed."""
    seen = Observation("bookmarks")
    marks = parse_bookmarks(raw).observe(seen, F.count(F.lit(1)).alias("rows"), F.count("kind").alias("parsed"), F.count_if(F.col("kind").isNull()).alias("failed"))
    marks = marks.filter("kind is not null")
    return (marks if bound is None else with_tags(marks, bound)), seen


def parse_bookmarks(raw: DataFrame) -> DataFrame:
    """Bookmarks of rows (local_id, type, update_time, content); ``kind`` is null where the XML can't be parsed. Content in bytes, compressed or not, is decoded first."""
    if isinstance(raw.schema["content"].dataType, BinaryType):
        raw = raw.withColumn("content", decode_blob(F.col("content")))
    x = F.from_xml(F.concat(F.lit("<_r>"), clean_xml(F.col("content")), F.lit("</_r>")), BOOKMARK)["favitem"]
    rows = raw.withColumn("_x", F.explode(F.array(x)))  # parsed once, whatever filters follow
    r = F.col("_x")
    item = lambda d: F.struct(
        F.coalesce(lookup(KINDS, to_long(d["_datatype"]).cast("int")), F.lit("other")).alias("kind"), F.coalesce(d["datatitle"], F.lit("")).alias("title"), F.coalesce(d["datadesc"], F.lit("")).alias("desc"),
        F.nullif(F.lower(d["fullmd5"]), F.lit("")).alias("fullmd5"), F.nullif(F.lower(d["thumbfullmd5"]), F.lit("")).alias("thumbmd5"), first_filled(d["stream_weburl"], d["weburl"]).alias("url"),
        d["datasrcname"].alias("sender_name"), d["dataitemsource"]["fromusr"].alias("from"), d["dataitemsource"]["realchatname"].alias("sender"),
    )
    empty = f"array<struct<{ITEM}>>"
    rows = rows.withColumns({"items": F.transform(F.coalesce(r["datalist"]["dataitem"], F.array().cast(empty)), item), "_type": F.coalesce(F.nullif(to_long(r["_type"]), F.lit(0)), F.col("type").cast("long"), F.lit(0)).cast("int")})
    rows = rows.withColumns({"_first": F.try_element_at("items", F.lit(1)), "_kind": F.when(r.isNotNull(), F.coalesce(lookup(KINDS, F.col("_type")), F.lit("other")))})
    first = F.col("_first")
    place = r["locitem"]
    return rows.select(
        F.col("local_id").alias("id"), F.col("_type").alias("type"), F.col("_kind").alias("kind"), F.coalesce(F.nullif(F.col("update_time"), F.lit(0)), to_long(r["source"]["createtime"]), F.lit(0)).alias("ts"),
        F.coalesce(first_filled(r["title"], r["weburlitem"]["pagetitle"], F.when(F.col("_kind") != "chat_record", first["title"])), F.lit("")).alias("title"),
        F.coalesce(first_filled(r["desc"], r["weburlitem"]["pagedesc"], F.when(F.size("items") == 1, first["desc"])), F.lit("")).alias("desc"),
        F.coalesce(first_filled(r["weburlitem"]["clean_url"], r["source"]["link"], first["url"]), F.lit("")).alias("url"),
        r["source"]["fromusr"].alias("from"), r["source"]["realchatname"].alias("sender"),
        F.filter(F.transform(F.coalesce(r["taglist"]["tag"], F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != "").alias("tags"),
        F.when(first_filled(place["poiname"], place["label"]).isNotNull() | to_double(place["lat"]).isNotNull(), first_filled(place["poiname"], place["label"])).alias("location"), "items",
    )


def with_tags(bookmarks: DataFrame, tags: DataFrame) -> DataFrame:
    """``bookmarks`` with the bound tags (id, tag) appended to those of the XML, none twice."""
    own = tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("_bound"))
    return bookmarks.join(own, "id", "left").withColumn("tags", F.array_union("tags", F.coalesce("_bound", F.array().cast("array<string>")))).drop("_bound")


def search_text() -> Column:
    parts = F.array_join(F.transform("items", lambda d: F.concat_ws("\n", d["title"], d["desc"], d["sender_name"])), "\n")
    return F.lower(F.concat_ws("\n", "title", "desc", "url", F.array_join("tags", " "), "location", parts))


def search_bookmarks(bookmarks: DataFrame, terms: Sequence[str] = (), kind: str | int | None = None, tag: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Parsed bookmarks with every term, of a kind or type number, with a tag; newest first."""
    out = bookmarks.filter(F.col("kind").isNotNull())
    if kind is not None:
        out = out.filter((F.col("type") == int(kind)) if str(kind).isdigit() else (F.col("kind") == kind))
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    if until is not None:
        out = out.filter(F.col("ts") < until)
    for t in terms:
        out = out.filter(F.contains(search_text(), F.lit(t.lower())))
    return out if limit is None else out.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def related_usernames() -> Column:
    """Everyone a bookmark came from."""
    every = F.concat(F.array("from", "sender"), F.flatten(F.transform("items", lambda d: F.array(d["from"], d["sender"]))))
    return F.filter(F.array_distinct(every), lambda u: F.coalesce(u, F.lit("")) != "")


def visible_bookmarks(bookmarks: DataFrame, hidden: DataFrame, own: str) -> DataFrame:
    """Bookmarks none of whose related people, oneself apart, is in ``hidden`` (username)."""
    bad = bookmarks.select("id", F.explode(related_usernames()).alias("username")).filter(F.col("username") != own).join(hidden, "username", "left_semi").select("id").distinct()
    return bookmarks.join(bad, "id", "left_anti")
