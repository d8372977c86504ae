"""Scalar functions on columns; each is one expression inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in columns])


def one_line(c: Column, limit: int | None = None) -> Column:
    """Runs of white space as one blank, trimmed; cut to ``limit`` characters with an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    if limit is None:
        return s
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("…"))).otherwise(s)


def joined(*parts: Column, sep: str = " ") -> Column:
    """Parts that are not empty, joined."""
    return F.concat_ws(sep, *[filled(p) for p in parts])


def in_parens(c: Column) -> Column:
    return F.when(filled(c).isNotNull(), F.concat(F.lit("("), c, F.lit(")")))


def pick_name(username: Column, remark: Column, nick_name: Column) -> Column:
    """A person's remark, else the nickname, else the username."""
    return F.coalesce(filled(F.trim(remark)), filled(F.trim(nick_name)), username)



def to_long(c: Column) -> Column:
    return F.trim(c).try_cast("long")


def to_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal above bytes."""
    step = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))
    return (
        F.when(n.isNull() | (n < 0), "")
        .when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, step(1, "KB"))
        .when(n < 1024**3, step(2, "MB"))
        .otherwise(step(3, "GB"))
    )


def clock(seconds: Column) -> Column:
    """A time of the session's zone, null for 0 and null."""
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def hms_seconds(c: Column) -> Column:
    """Seconds of m:ss or h:mm:ss."""
    return F.aggregate(F.split(c, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long"))


def duration_label(seconds: Column) -> Column:
    """m:ss from a minute on, else seconds with a quote mark."""
    s = seconds.cast("int")
    return F.when(s >= 60, F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)).otherwise(F.format_string('%d"', s))


def unsigned_id(c: Column) -> Column:
    """A signed 64-bit number as the unsigned one's digits."""
    return F.conv(c.cast("string"), 10, 10)


def table_name_for(username: Column) -> Column:
    return F.concat(F.lit("Msg_"), F.md5(username.cast("string").cast("binary")))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *parts).cast("binary"))


def message_id(db: Column, local_id: Column) -> Column:
    return F.concat_ws(":", db.cast("string"), local_id.cast("string"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def safe_filename(c: Column, limit: int = 150, fallback: Column | None = None) -> Column:
    """Characters that file systems refuse become underscores; blanks and dots at the ends go, and what is empty then is ``fallback``."""
    s = _stripped(F.btrim(_stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f\x7f]', "_")), F.lit(".")))
    return F.coalesce(filled(F.substring(s, 1, limit)), F.lit("unnamed") if fallback is None else fallback)


def parse_message_id(c: Column) -> Column:
    """``N:local_id`` as a struct (db, local_id); null for anything else."""
    part = lambda k: F.regexp_extract(c, r"^\s*(\d+):(\d+)\s*$", k).try_cast("long")
    return F.when(c.rlike(r"^\s*\d+:\d+\s*$"), F.struct(part(1).cast("int").alias("db"), part(2).alias("local_id")))


def voice_stem(server_id: Column, create_time: Column, local_id: Column) -> Column:
    """The file stem of a voice message: its server's id, else its time and number."""
    return F.coalesce(F.nullif(server_id, F.lit(0)).cast("string"), F.concat_ws("_", create_time.cast("string"), local_id.cast("string")))


def relative_path(path: Column, folder: Column, quoted: bool = False) -> Column:
    """``path`` as seen from ``folder``, with forward slashes; ``quoted`` for use in links."""
    p, f = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(folder, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    out = F.when(F.startswith(p, f), F.substring(p, F.length(f) + 1, F.length(p))).otherwise(p)
    return quote_url(out) if quoted else out


def quote_url(c: Column) -> Column:
    """Percent-encoded, slashes as they are."""
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(F.url_encode(c) if a == "+" else c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column) -> Column:
    """Angle brackets can't open a tag."""
    return F.replace(c, F.lit("<"), F.lit("&lt;"))


def link_text(c: Column) -> Column:
    """Text between a link's brackets: on one line, its own brackets escaped."""
    return F.regexp_replace(escape_markdown(one_line(c)), r"([\[\]])", r"\\$1")


def host_allowed(host: Column, suffixes: Sequence[str]) -> Column:
    """Whether a host is one of ``suffixes`` or below one."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (host == s) | F.endswith(host, F.lit("." + s))
    return F.coalesce(out, F.lit(False))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<[^>]+>", ""))


def safe_url(c: Column) -> Column:
    """A web address, null for any other scheme."""
    return F.when(c.rlike(r"(?i)^https?://"), c)


def url_host(c: Column) -> Column:
    """The host of a web address, lower-cased, without user and port."""
    return F.when(c.rlike(r"(?i)^https?://"), F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def cap_text(c: Column, limit: int = 4000) -> Column:
    """At most ``limit`` characters, with a note of how many more there are."""
    more = (F.length(c) - limit).cast("string")
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…[+"), more, F.lit(" chars]"))).otherwise(c)


def snippet(c: Column, terms: Sequence[str], width: int = 60) -> Column:
    """``width`` characters either side of where the first term, in the order given, that the text has begins; a text of up to 2 * ``width`` + 20 is whole."""
    text = F.coalesce(c, F.lit(""))
    low, n = F.lower(text), F.length(text)
    at = F.lit(0)
    for t in reversed(terms):
        at = F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())).otherwise(at)
    begin, end = F.greatest(at - F.lit(1 + width), F.lit(0)), F.least(at - F.lit(1) + width, n)
    near = F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < n, "…").otherwise(""))
    return F.when(n <= 2 * width + 20, text).when(at == 0, F.concat(F.substring(text, 1, 2 * width), F.lit("…"))).otherwise(near)


def fold_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def match_rank(name: Column, pattern: Column) -> Column:
    """0 for an equal name, 1 for one equal but for case, 2 for one that has the pattern, else null."""
    return (
        F.when(name == pattern, 0)
        .when(F.lower(name) == F.lower(pattern), 1)
        .when((pattern != "") & F.contains(F.lower(name), F.lower(pattern)), 2)
    )


def parse_time(c: Column, now: Column, end: bool = False) -> Column:
    """Unix seconds of ``9-11 digits``, a date, a date and time, an ISO time with offset, or an age as 30m, 12h, 7d, 2w.

    With ``end`` a date alone means its last second. Anything else is null.
    """
    s = F.replace(F.trim(c), F.lit("/"), F.lit("-"))
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in (("m", 60), ("h", 3600), ("d", 86400), ("w", 604800)) for x in kv]), F.lower(F.right(s, F.lit(1))))
    day = F.unix_seconds(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    return (
        F.when(s.rlike(r"^\d{9,11}$"), s.try_cast("long"))
        .when(s.rlike(r"(?i)^\d+\s*[mhdw]$"), now - F.trim(F.substring(s, F.lit(1), F.length(s) - 1)).try_cast("long") * unit)
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), day + F.lit(86399 if end else 0))
        .otherwise(F.unix_seconds(F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" ")))))
    )


# The named entities of XML.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def unescape_entities(s: Column) -> Column:
    """``s`` with named and numeric entities undone, each once: what an undone one spells stays as it is."""
    parts = F.regexp_extract_all(F.concat(s, F.lit("&;")), F.lit(r"(?s)(.*?)(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|amp|);)"), 1)
    marks = F.regexp_extract_all(F.concat(s, F.lit("&;")), F.lit(r"(?s)(.*?)&((?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|lt|gt|quot|apos|amp|));"), 2)

    def undone(m: Column) -> Column:
        code = F.when(F.lower(m).startswith("#x"), F.conv(F.substring(m, 3, 6), 16, 10)).when(m.startswith("#"), F.substring(m, 2, 7)).cast("long")
        # A code point as UTF-32, which Java reads; what is none stays.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.create_map(*[x for k, v in ENTITIES.items() for x in (F.lit(k), F.lit(v))])
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(m == "", "").when(known, char).otherwise(F.coalesce(F.try_element_at(named, m), F.concat(F.lit("&"), m, F.lit(";"))))

    return F.array_join(F.zip_with(parts, F.transform(marks, undone), lambda p, m: F.concat(p, m)), "")
