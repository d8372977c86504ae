"""Bytes to values: compressed text, room member lists, media durations.

Only what no built-in function can read is a Python function: zstd frames row by row, and in Arrow batches protobuf
messages and the nested boxes, chunks and frames of media files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


@cache
def _reader():
    import zstandard

    return zstandard.ZstdDecompressor()


# Row by row, as Spark then sends 100 rows at a time: an Arrow batch has up to 10,000 texts, however long they are.
@F.udf(T.StringType(), useArrow=False)
def _inflate(body: bytes | None) -> str | None:
    import zstandard

    if body is None:
        return None
    try:
        frame = _reader().decompressobj()
        out = frame.decompress(bytes(body))
        return out.decode("utf-8", errors="replace") if frame.eof else None  # a frame cut short is broken
    except zstandard.ZstdError:
        return None


def decode_content(content: Column, compression: Column) -> Column:
    """The text of a message: zstd where ``compression`` is 4, plain UTF-8 otherwise; null for a broken frame or other bytes."""
    plain = F.when(F.is_valid_utf8(F.try_validate_utf8(content.cast("string"))), content.cast("string"))
    return F.when(compression == 4, _inflate(F.when(compression == 4, content))).otherwise(plain)


def decode_blob(content: Column) -> Column:
    """The text of a post or bookmark: zstd if it starts like a frame, else UTF-8 with replaced bad bytes."""
    packed = F.startswith(content, F.lit(ZSTD_MAGIC))
    return F.when(packed, _inflate(F.when(packed, content))).otherwise(F.make_valid_utf8(content.cast("string")))


def delimited_fields(message: bytes) -> Iterator[tuple[int, bytes]]:
    """(field number, payload) of the length-delimited fields of a protobuf message; ends at the first byte that makes no sense."""
    at = 0

    def number() -> int | None:
        nonlocal at
        stop = next((k for k in range(at, min(at + 10, len(message))) if message[k] < 128), None)
        if stop is None:
            return None
        value = sum((b & 127) << (7 * k) for k, b in enumerate(message[at : stop + 1]))
        at = stop + 1
        return value

    fixed = {1: 8, 5: 4}
    while at < len(message):
        key = number()
        if key is None:
            return
        kind = key & 7
        if kind in fixed:
            at += fixed[kind]
        elif kind == 0:
            if number() is None:
                return
        elif kind == 2:
            size = number()
            if size is None or at + size > len(message):
                return
            yield key >> 3, message[at : at + size]
            at += size
        else:
            return


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("member", T.StringType()), T.StructField("group_nick", T.StringType())])))
def _members(buffers: pd.Series) -> pd.Series:
    def read(buffer):
        found: dict[str, str] = {}
        for field, person in delimited_fields(bytes(buffer or b"")):
            if field == 1:
                names = dict(delimited_fields(person))
                member = names.get(1, b"").decode("utf-8", errors="replace")
                if member:
                    found[member] = names.get(2, b"").decode("utf-8", errors="replace").strip()
        return [{"member": m, "group_nick": n} for m, n in found.items()]

    return buffers.map(read)


def room_members(rooms: DataFrame) -> DataFrame:
    """(room, pos, member, group_nick) of rows (room, ext_buffer), in the buffer's order; what a broken buffer holds before the break is kept."""
    each = rooms.select("room", F.posexplode(_members("ext_buffer")).alias("pos", "m"))
    return each.select("room", "pos", "m.member", "m.group_nick")


# How files begin.
HEADS = {b"\xff\xd8\xff": "jpg", b"\x89PNG": "png", b"GIF8": "gif", b"BM": "bmp", b"#!AMR": "amr"}
SILK = b"#!SILK_V3"
#: Boxes of an MP4 file that only hold others, on the way to the movie header.
HOLDERS = (b"moov",)


def _boxes(body: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(name, contents) of the MP4 boxes side by side in ``body``; ends where a size can't be."""
    at = 0
    while at + 8 <= len(body):
        size, head = int.from_bytes(body[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(body[at + 8 : at + 16], "big"), 16
        size = size or len(body) - at
        if size < head:
            return
        yield bytes(body[at + 4 : at + 8]), body[at + head : at + size]
        at += size


def _movie_seconds(body: memoryview) -> float | None:
    """Duration / time scale of the movie header, found by walking boxes, never inside what they hold."""
    for name, inner in _boxes(body):
        if name in HOLDERS:
            return _movie_seconds(inner)
        if name == b"mvhd":
            at, wide = (20, 8) if inner[:1] == b"\x01" else (12, 4)
            scale, length = int.from_bytes(inner[at : at + 4], "big"), int.from_bytes(inner[at + 4 : at + 4 + wide], "big")
            return length / scale if scale and len(inner) >= at + 4 + wide else None
    return None


def _wave_seconds(body: memoryview) -> float | None:
    """Bytes of the data chunk over bytes per second, by walking the chunks of a RIFF file."""
    at, rate = 12, 0
    while at + 8 <= len(body):
        name, size = bytes(body[at : at + 4]), int.from_bytes(body[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate = int.from_bytes(body[at + 16 : at + 20], "little")
        if name == b"data":
            return size / rate if rate else None
        at += 8 + size + size % 2
    return None


def _silk_frames(body: bytes) -> int | None:
    start = bytes(body[: len(SILK) + 1]).find(SILK)
    if start not in (0, 1):
        return None
    at, n = start + len(SILK), 0
    while 0 < (size := int.from_bytes(body[at : at + 2], "little", signed=True)) <= len(body) - at - 2:
        at, n = at + 2 + size, n + 1
    return n


def _profile(body: bytes | None) -> tuple[str | None, float | None]:
    if body is None:
        return None, None
    view = memoryview(body)
    if (frames := _silk_frames(body)) is not None:
        return "silk", frames * 0.02
    if body[:4] == b"RIFF":
        kind = {b"WAVE": "wav", b"WEBP": "webp"}.get(bytes(body[8:12]), "bin")
        return kind, _wave_seconds(view) if kind == "wav" else None
    if body[4:8] in (b"ftyp", b"moov"):
        return "m4a" if body[8:11] == b"M4A" else "mp4", _movie_seconds(view)
    return next((kind for head, kind in HEADS.items() if body.startswith(head)), "bin"), None


@F.pandas_udf(T.StructType().add("fmt", T.StringType()).add("seconds", T.DoubleType()))
def media_profile(bodies: pd.Series) -> pd.DataFrame:
    """A file's format, by its first bytes, and its length in seconds, by a walk over its boxes, chunks or frames; null where it has none."""
    return pd.DataFrame([_profile(b) for b in bodies], columns=["fmt", "seconds"])


@F.pandas_udf(T.LongType())
def silk_frames(bodies: pd.Series) -> pd.Series:
    """The number of 20 ms frames of a SILK stream, each behind its length; null for anything else."""
    return bodies.map(lambda b: None if b is None else _silk_frames(b)).astype("Int64")


def media_seconds(kind: Column, content: Column) -> Column:
    """Seconds of a voice, audio or video file by its kind: silk, wav, mp4 or m4a."""
    found = media_profile(content)
    same = (kind == found["fmt"]) | (kind.isin("mp4", "m4a") & found["fmt"].isin("mp4", "m4a"))
    return F.when(same, found["seconds"])
