import io
import struct
import wave

import zstandard
from pyspark.sql import functions as F

from chatlake.functions import decoders
from chatlake.plans import row_queries
from tests.conftest import SF


def test_decode_content(spark):
    packed = zstandard.compress("compressed hi é".encode())
    rows = [(1, packed, 4), (2, b"plain", 0), (3, b"\xff\xfe", 0), (4, packed[:9], 4), (5, None, 4), (6, None, None)]
    df = spark.createDataFrame(rows, "i int, c binary, ct int")
    got = {r.i: r.t for r in df.select("i", decoders.decode_content(F.col("c"), F.col("ct")).alias("t")).collect()}
    assert got[1] == "compressed hi é" and got[2] == "plain" and got[3] is None and got[5] is None and got[6] is None
    blobs = {r.i: r.t for r in df.select("i", decoders.decode_blob(F.col("c")).alias("t")).collect()}
    assert blobs[1] == "compressed hi é" and blobs[3] == "��"


def test_texts_are_decoded_a_few_at_a_time(spark, capsys):
    packed = zstandard.compress(b"x" * 100_000)
    df = spark.createDataFrame([(i, packed, 4) for i in range(500)], "i int, c binary, ct int").coalesce(1)
    for text in (decoders.decode_content(F.col("c"), F.col("ct")), decoders.decode_blob(F.col("c"))):
        found = df.select("i", F.length(text).alias("n"))
        found.explain()
        # Arrow batches hold up to 10,000 rows of any length.
        assert "ArrowEvalPython" not in capsys.readouterr().out
        assert {r.n for r in found.collect()} == {100_000}


def test_texts_are_packed_and_decoded_a_few_at_a_time(spark, capsys):
    for query in (row_queries.decoded_content, row_queries.decoded_blobs):
        query(spark, SF).explain()
        plan = capsys.readouterr().out
        assert plan.count("BatchEvalPython [_packed") == 1 == plan.count("BatchEvalPython [_inflate") and "Arrow" not in plan


def field(number, payload):
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_room_members(spark):
    a = field(1, field(1, b"alice") + field(2, b" Al "))
    b = field(1, b"\x18\x96\x01" + field(1, b"bob"))
    rows = [("r1", a + b"\x10\x05" + b), ("r2", a + b"\x0a\x7fcut"), ("r3", None), ("r4", b"\xff" * 12)]
    got = decoders.room_members(spark.createDataFrame(rows, "room string, ext_buffer binary")).collect()
    assert sorted(map(tuple, got)) == [("r1", 0, "alice", "Al"), ("r1", 1, "bob", ""), ("r2", 0, "alice", "Al")]


def test_media_seconds(spark):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 8000)
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    short = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500) + b"\0" * 8))
    long = box(b"moov", box(b"mvhd", b"\x01" + b"\0" * 19 + struct.pack(">IQ", 600, 1200) + b"\0" * 8))
    silk = b"\x02#!SILK_V3" + b"".join(struct.pack("<h", n) + b"x" * n for n in (3, 5, 1)) + b"\xff\xff"
    rows = [("wav", buffer.getvalue(), 0.5), ("mp4", short, 2.5), ("m4a", long, 2.0), ("silk", silk, 0.06), ("silk", b"#!AMR", None), ("mp4", b"junk", None), ("wav", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, c binary, want double").repartition(2)
    for r in df.withColumn("got", decoders.media_seconds(F.col("kind"), F.col("c"))).collect():
        assert r.got == r.want or abs(r.got - r.want) < 1e-9, r.i
