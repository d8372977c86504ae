"""Text, Markdown and HTML lines of records with what belongs to them: pictures, sound, films, links, quotes, forwarded messages.

A record has sender, ts, is_self, kind, text and may have extra (JSON, as ``enrich`` gives it), seconds, image_path, audio_path,
video_path, poster_path and ``items``; a column that isn't there counts as empty. Everything is a column expression of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.scalars import clock, escape_html, escape_markdown, one_line, quote_url, safe_url
from chatlake.operators.messages import with_day_headings

KEY = ("chat", "db", "local_id")
OPTIONAL = {"extra": "string", "seconds": "double", "image_path": "string", "audio_path": "string", "video_path": "string", "poster_path": "string", "items": "array<struct<path:array<int>,depth:int,sender:string,ts:bigint,text:string,url:string>>"}
# What stands before a link, and in place of a recording's text.
LINK_MARKS = {"link": "[链接]", "music": "[音乐]"}
RECORDINGS = {"voice": "语音", "video": "视频"}


def with_items(records: DataFrame, items: DataFrame) -> DataFrame:
    """``records`` with the items (chat, db, local_id, path, depth, sender, ts, text, url) of their bundles as ``items``, in order."""
    one = F.struct("path", "depth", "sender", F.col("ts").alias("ts"), "text", "url")
    per = items.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("items"))  # one message's
    return records.join(per, list(KEY), "left")


def _whole(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in records.columns})


def _padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def recording_length(kind: Column, seconds: Column) -> Column:
    """12 seconds of voice as 12″, of film as 0:12, from an hour on as 1:02:03."""
    s = seconds.cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    film = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), _padded(minutes), F.lit(":"), _padded(rest))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), _padded(rest)))
    return F.when(kind == "voice", F.concat(s.cast("string"), F.lit("″"))).otherwise(film)


def label(kind: Column, text: Column, seconds: Column) -> Column:
    """A record's text; of a recording whose length is known, its kind and length."""
    name = F.when(kind == "voice", RECORDINGS["voice"]).when(kind == "video", RECORDINGS["video"])
    return F.when(name.isNotNull() & seconds.isNotNull(), F.concat(F.lit("["), name, F.lit(" "), recording_length(kind, seconds), F.lit("]"))).otherwise(F.coalesce(text, F.lit("")))


def _of(name: str) -> Column:
    return F.get_json_object("extra", f"$.{name}")


def _md_title(c: Column) -> Column:
    return F.regexp_replace(escape_markdown(c), r"([\\\[\]])", r"\\$1")


def _md_address(url: Column) -> Column:
    """A link's address without what would end it: blanks, quotes and round brackets are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.replace(url, F.lit("("), F.lit("%28")), r"\)", "%29"), r'[<>"\\^`{|}]', "%20")


def _each(line) -> Column:
    """The items' lines, one below the other; null without any."""
    return F.when(F.size("items") > 0, F.array_join(F.transform("items", line), "\n"))


def _item_time(x: Column) -> Column:
    return F.coalesce(clock(x["ts"]), F.lit(""))


def txt_lines(records: DataFrame) -> DataFrame:
    """``line``: ``[time] sender: text``, with forwarded messages below, four blanks deeper a level."""
    pad = lambda x: F.repeat(F.lit("    "), x["depth"])
    line = lambda x: F.concat(pad(x), F.lit("["), _item_time(x), F.lit("] "), F.coalesce(x["sender"], F.lit("")), F.lit(": "), F.replace(F.coalesce(x["text"], F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), pad(x), F.lit("  "))))
    rows = _whole(records)
    head = F.concat(F.lit("["), clock(F.col("ts")), F.lit("] "), F.col("sender"), F.lit(": "), label(F.col("kind"), F.col("text"), F.col("seconds")))
    return rows.withColumn("line", F.concat_ws("\n", head, _each(line))).select(*records.columns, "line")


def md_lines(records: DataFrame) -> DataFrame:
    """``line``: a day's heading where it begins, ``**sender** HH:MM  body``, and below it a quote or the forwarded messages."""
    rows, c = with_day_headings(_whole(records)), F.col
    text = label(c("kind"), c("text"), c("seconds"))
    plain = escape_markdown(text)
    image = lambda path: F.concat(F.lit("!["), plain, F.lit("]("), quote_url(path), F.lit(")"))
    played = F.concat(F.lit("▶ "), F.when(plain.rlike(r"(?s)^\[.*\]$"), F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain))
    shown = F.when(plain.rlike(r"(?s)^\[.*\]$"), played).otherwise(plain)
    source = quote_url(F.coalesce("audio_path", "video_path"))
    poster = F.when(c("video_path").isNotNull() & c("audio_path").isNull() & c("poster_path").isNotNull(), F.concat(F.lit("[!["), shown, F.lit("]("), quote_url(c("poster_path")), F.lit(")]("), source, F.lit(")")))
    url = safe_url(_of("url"))
    mark = F.when(c("kind") == "link", LINK_MARKS["link"]).when(c("kind") == "music", LINK_MARKS["music"])
    link = F.concat(mark, F.lit(" ["), _md_title(F.coalesce(F.nullif(_of("title"), F.lit("")), url)), F.lit("]("), _md_address(url), F.lit(")"), F.coalesce(F.concat(F.lit(" ("), escape_markdown(F.nullif(_of("source"), F.lit(""))), F.lit(")")), F.lit("")))
    quote = (c("kind") == "quote") & _of("text").isNotNull()
    below = lambda x: F.concat(F.repeat(F.lit("> "), x["depth"]))
    said = lambda x: F.coalesce(F.concat(F.lit("["), _md_title(x["text"]), F.lit("]("), _md_address(safe_url(x["url"])), F.lit(")")), escape_markdown(F.coalesce(x["text"], F.lit(""))))
    item = lambda x: F.concat(below(x), F.lit("**"), escape_markdown(F.coalesce(x["sender"], F.lit(""))), F.lit("** "), _item_time(x), F.lit(": "), F.replace(said(x), F.lit("\n"), F.concat(F.lit("  \n"), below(x))), F.lit("  "))
    body = (
        F.when(c("image_path").isNotNull(), image(c("image_path"))).when(poster.isNotNull(), poster).when(source.isNotNull(), F.concat(F.lit("["), shown, F.lit("]("), source, F.lit(")")))
        .when(c("poster_path").isNotNull(), image(c("poster_path"))).otherwise(F.replace(F.when(quote, escape_markdown(F.coalesce(_of("reply"), F.lit("")))).otherwise(F.coalesce(link, plain)), F.lit("\n"), F.lit("  \n")))
    )
    quoted = F.when(quote, F.concat(F.lit("> "), escape_markdown(F.coalesce(_of("sender"), F.lit(""))), F.lit(": "), one_line(escape_markdown(_of("text")))))
    media = c("image_path").isNotNull() | source.isNotNull() | c("poster_path").isNotNull()
    after = F.when(~media, F.concat_ws("\n", quoted, _each(item)))
    heading = F.when(c("new_day"), F.concat(F.lit("## "), c("day"), F.lit("\n\n"))).otherwise("")
    line = F.concat(heading, F.lit("**"), escape_markdown(c("sender")), F.lit("** "), F.substring(clock(c("ts")), 12, 5), F.lit("  "), body, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.nullif(after, F.lit("")), F.lit("\n")), F.lit("")))
    return rows.withColumn("line", line).select(*records.columns, "line")


def html_lines(records: DataFrame) -> DataFrame:
    """``line``: a bubble on one's own or the other side, a system row, or a day's separator before either; every text and address is escaped."""
    rows, c = with_day_headings(_whole(records)), F.col
    text = escape_html(label(c("kind"), c("text"), c("seconds")))
    tag = lambda name, inner, **a: F.concat(F.lit(f"<{name}"), *[p for k, v in a.items() for p in (F.lit(f' {k}="'), v, F.lit('"'))], F.lit(">"), inner, F.lit(f"</{name}>"))
    anchor = lambda url, inner: tag("a", inner, href=escape_html(url), rel=F.lit("noopener noreferrer nofollow"))
    div = lambda kind, inner: tag("div", inner, **{"class": F.lit(kind)})
    file = lambda path: escape_html(quote_url(path))
    image = lambda path: F.concat(F.lit('<img loading="lazy" src="'), file(path), F.lit('" alt="'), text, F.lit('">'))
    length = F.when(c("kind").isin(*RECORDINGS) & c("seconds").isNotNull(), tag("span", recording_length(c("kind"), c("seconds")), **{"class": F.lit("dur")})).otherwise("")
    poster = F.coalesce(F.concat(F.lit(' poster="'), file(c("poster_path")), F.lit('"')), F.lit(""))
    url = safe_url(_of("url"))
    mark = F.when(c("kind") == "link", LINK_MARKS["link"] + " ").when(c("kind") == "music", LINK_MARKS["music"] + " ")
    meta = lambda v: F.coalesce(div("meta", escape_html(F.nullif(v, F.lit("")))), F.lit(""))
    about = F.substring(F.trim(F.coalesce(F.nullif(_of("desc"), F.lit("")), _of("artist"))), 1, 300)
    link = F.concat(mark, anchor(url, escape_html(F.coalesce(F.nullif(_of("title"), F.lit("")), url))), meta(about), meta(_of("source")))
    quote = F.when((c("kind") == "quote") & _of("text").isNotNull(), F.concat(escape_html(F.coalesce(_of("reply"), F.lit(""))), div("quote", F.concat(escape_html(F.coalesce(_of("sender"), F.lit(""))), F.lit(": "), escape_html(_of("text"))))))
    said = lambda x: F.coalesce(anchor(safe_url(x["url"]), escape_html(x["text"])), escape_html(F.coalesce(x["text"], F.lit(""))))
    item = lambda x: F.concat(F.lit('<div class="ri d'), x["depth"].cast("string"), F.lit('">'), tag("b", escape_html(F.coalesce(x["sender"], F.lit("")))), F.lit(" "), tag("i", _item_time(x)), F.lit(" "), said(x), F.lit("</div>"))
    bundle = F.when(F.size("items") > 0, tag("details", F.concat(tag("summary", text), F.array_join(F.transform("items", item), ""))))
    body = (
        F.when(c("image_path").isNotNull(), image(c("image_path")))
        .when(c("audio_path").isNotNull(), F.concat(F.lit('<audio controls preload="none" src="'), file(c("audio_path")), F.lit('"></audio>'), length))
        .when(c("video_path").isNotNull(), F.concat(F.lit('<video controls preload="none"'), poster, F.lit(' src="'), file(c("video_path")), F.lit('"></video>'), length))
        .when(c("poster_path").isNotNull(), F.concat(image(c("poster_path")), length)).otherwise(F.coalesce(quote, link, bundle, text))
    )
    day = F.when(c("new_day"), F.concat(div("day", c("day")), F.lit("\n"))).otherwise("")
    side = F.when(c("is_self"), "msg self").otherwise("msg other")
    bubble = tag("div", F.concat(tag("b", escape_html(c("sender"))), tag("p", body)), **{"class": side})
    return rows.withColumn("line", F.concat(day, F.when(c("kind").isin("system", "pat"), div("sys", text)).otherwise(bubble))).select(*records.columns, "line")
