"""Lines with media, links, quotes and forwarded messages."""

import json

import pytest
from pyspark.sql import functions as F

from chatlake.operators import render_rich as R

SCHEMA = "chat string, db int, dbr int, local_id long, ts long, sender string, is_self boolean, kind string, text string, extra string, seconds double, image_path string, audio_path string, video_path string, poster_path string"
LINK = json.dumps({"title": "A [b] <i>", "url": "https://x.org/a(1)?q=é", "source": "S<", "desc": "about"})
ROWS = [
    ("text", "a<b\nc", None, None, {}), ("image", "[图片]", None, None, {"image_path": "m/a b.jpg"}), ("voice", "[语音]", None, 12.0, {"audio_path": "v/1.m4a"}), ("video", "[视频]", None, 3723.0, {"video_path": "f.mp4", "poster_path": "p.jpg"}),
    ("video", "[视频]", None, None, {"poster_path": "p.jpg"}), ("link", "[链接] x", LINK, None, {}), ("quote", "r [引用 s: t]", json.dumps({"reply": "r<", "sender": "s", "text": "t\nu"}), None, {}), ("link", "[链接] y", json.dumps({"title": "y", "url": "javascript:1"}), None, {}),
    ("system", "joined <x>", None, None, {}), ("chat_history", "[聊天记录] two", None, None, {}),
]


@pytest.fixture(scope="module")
def records(spark):
    paths = ("image_path", "audio_path", "video_path", "poster_path")
    rows = [("a", 0, 0, i, 60 + i, "s*<", i == 2, kind, text, extra, seconds, *(p.get(k) for k in paths)) for i, (kind, text, extra, seconds, p) in enumerate(ROWS)]
    items = spark.createDataFrame([("a", 0, 9, [1, 0], 2, "in", None, "deep", "https://y.org"), ("a", 0, 9, [0], 1, "s<", 60, "one\ntwo", None), ("a", 0, 9, [1], 1, None, None, "[聊天记录] t", "ftp://no")], "chat string, db int, local_id long, path array<int>, depth int, sender string, ts long, text string, url string")
    return R.with_items(spark.createDataFrame(rows, SCHEMA), items)


def lines(df):
    return [r.line for r in df.orderBy("local_id").collect()]


def test_txt(records):
    got = lines(R.txt_lines(records))
    assert got[2] == "[1970-01-01 00:01:02] s*<: [语音 12″]" and got[3].endswith(": [视频 1:02:03]") and got[4].endswith(": [视频]")
    assert got[9] == "[1970-01-01 00:01:09] s*<: [聊天记录] two\n    [1970-01-01 00:01:00] s<: one\n      two\n    [] : [聊天记录] t\n        [] in: deep"


def test_md(records):
    got = lines(R.md_lines(records))
    assert got[0] == "## 1970-01-01\n\n**s*&lt;** 00:01  a&lt;b  \nc\n"
    assert [x.split("  ", 1)[1] for x in got[1:5]] == ["![[图片]](m/a%20b.jpg)\n", "[▶ 语音 12″](v/1.m4a)\n", "[![▶ 视频 1:02:03](p.jpg)](f.mp4)\n", "![[视频]](p.jpg)\n"]
    assert got[5].endswith("  [链接] [A \\[b\\] &lt;i>](https://x.org/a%281%29?q=é) (S&lt;)\n")
    assert got[6].endswith("  r&lt;\n\n> s: t u\n") and got[7].endswith("  [链接] y\n") and "javascript" not in got[7]
    assert got[9].endswith("  [聊天记录] two\n\n> **s&lt;** 1970-01-01 00:01:00: one  \n> two  \n> **** : [聊天记录] t  \n> > **in** : [deep](https://y.org)  \n")


def test_html(records):
    got = lines(R.html_lines(records))
    assert got[0] == '<div class="day">1970-01-01</div>\n<div class="msg other"><b>s*&lt;</b><p>a&lt;b\nc</p></div>'
    assert '<img loading="lazy" src="m/a%20b.jpg" alt="[图片]">' in got[1] and got[2].startswith('<div class="msg self">') and '<audio controls preload="none" src="v/1.m4a"></audio><span class="dur">12″</span>' in got[2]
    assert '<video controls preload="none" poster="p.jpg" src="f.mp4"></video><span class="dur">1:02:03</span>' in got[3] and '<img loading="lazy" src="p.jpg"' in got[4]
    assert '<a href="https://x.org/a(1)?q=é" rel="noopener noreferrer nofollow">A [b] &lt;i&gt;</a><div class="meta">about</div><div class="meta">S&lt;</div>' in got[5]
    assert '<p>r&lt;<div class="quote">s: t\nu</div></p>' in got[6] and "javascript" not in got[7] and got[8] == '<div class="sys">joined &lt;x&gt;</div>'
    assert '<details><summary>[聊天记录] two</summary><div class="ri d1"><b>s&lt;</b>' in got[9] and '<a href="https://y.org"' in got[9] and "ftp" not in got[9]


def test_columns_that_are_missing_count_as_empty(records):
    few = records.select("chat", "db", "dbr", "local_id", "ts", "sender", "is_self", "kind", "text").filter("local_id in (0, 3)")
    assert lines(R.md_lines(few))[1].endswith("  [视频]\n") and lines(R.txt_lines(few.filter(F.lit(False)))) == []
    assert R.html_lines(few).columns == [*few.columns, "line"]
