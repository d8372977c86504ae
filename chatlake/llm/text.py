"""Words of whole Arrow text columns as numpy arrays of hashes.

A word is a run of bytes outside a separator set. All functions work on the
UTF-8 bytes of a column at once, in chunks of whole rows, so a task needs memory
for a chunk and for its longest single text.

A word's identity is 128 bits in two lanes: eight bytes of the word at a time go through a
keyed mixing step of each lane, and a word over LONG_WORD bytes is digested by BLAKE2.
Lane one alone (``hashes``) only ever brings candidates together; what is removed or linked
is decided by both lanes, by a BLAKE2 digest of the words' bytes, or by the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LONG_WORD = 256
_rng = np.random.default_rng(20240817)
#: Keys of the mixing steps: of each lane, for a word's length, for its bytes, and for joining two neighbours.
_KEYS = _rng.integers(1, 1 << 63, (2, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.bytes(16)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:  # one huge text must not stay in the worker's memory
            _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from its contents and length alone; for features, not for identity."""
    p = _prefix(values)
    h = (p[ends] - p[starts]) * _power(_INVERSE, len(p))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lookup(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SPACE = lookup(SPACES)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)


def digest(body: memoryview) -> bytes:
    """128 bits that stand for some bytes."""
    return hashlib.blake2b(body, digest_size=16, key=_SEED).digest()


def _long_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view = memoryview(body)
    return np.frombuffer(b"".join(digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64).reshape(-1, 2)


def word_lanes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes of the words body[start:end]; ``body`` has eight more bytes than the text."""
    eights = np.ndarray(len(body) - 7, "<u8", body.data, strides=(1,))
    left, at, live = ends - starts, starts, np.arange(len(starts))
    one, two = mix(left.astype(np.uint64) * _KEYS[0, 0]), mix(left.astype(np.uint64) * _KEYS[1, 0])
    large = np.flatnonzero(left > LONG_WORD)
    if len(large):
        one[large], two[large] = _long_words(body, starts[large], ends[large]).T
        few = left <= LONG_WORD
        left, at, live = left[few], at[few], live[few]
    while len(live):
        x = eights[at] & _LOW[np.minimum(left, 8)]
        one[live], two[live] = mix(one[live] ^ x * _KEYS[0, 1]), mix((two[live] + x) * _KEYS[1, 1])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return one, two


@dataclass
class Words:
    """The words of some rows: row i has words first[i] to first[i + 1]; ``hashes`` and ``second`` are the two lanes."""

    hashes: np.ndarray
    second: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    row0: int

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a text or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # what lies under a null is not text
        valid = np.asarray(column.is_valid())
        if np.diff(off)[~valid].any():
            return raw(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return body, off - off[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, of CHUNK_BYTES or one longer row."""
    data, off = raw(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()  # a worker waits for its next stage with little memory


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True within rows, and the first run of each row."""
    n = len(inside)
    edges = np.zeros(n + 1, bool)
    edges[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edges[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edges[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(column: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a text column, chunk by chunk; ``lower`` folds A-Z in the hashes."""
    for row0, data, off in chunks(column):
        starts, ends, first = runs(~separators[data], off)
        body = np.zeros(len(data) + 8, np.uint8)
        body[: len(data)] = _FOLD[data] if lower else data
        yield Words(*word_lanes(body, starts, ends), first, starts, ends, data, off, row0)


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each kept word starts in them, where each row starts): the kept words of each row joined by one space."""
    s, e, rows = (x if keep is None else x[keep] for x in (w.starts, w.ends, w.row_of()))
    n = np.bincount(rows, minlength=w.rows)
    size = e - s + 1
    size[np.cumsum(n)[n > 0] - 1] -= 1  # no space after a row's last word
    off = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    out = np.full(off[-1], 0x20, np.uint8)
    n_word = e - s
    rel = np.arange(n_word.sum()) - np.repeat(np.cumsum(n_word) - n_word, n_word)
    out[np.repeat(off[:-1], n_word) + rel] = w.data[np.repeat(s, n_word) + rel]
    bounds = np.zeros(w.rows + 1, np.int64)
    bounds[1:] = off[np.cumsum(n)]
    return out, off[:-1], bounds


def joined_digests(w: Words, begin: np.ndarray, end: np.ndarray, plain: tuple[np.ndarray, np.ndarray] | None = None) -> list[bytes]:
    """The digest of the words begin to end, joined by one space, for each pair."""
    body, at = plain or joined(w)[:2]
    size = w.ends - w.starts
    view = memoryview(body)
    return [digest(view[a:b]) for a, b in zip(at[begin].tolist(), (at[end - 1] + size[end - 1]).tolist(), strict=True)]


def _beside(x: np.ndarray, y: np.ndarray, lane: int, step: int) -> np.ndarray:
    return mix(x * _KEYS[lane, 2] + (y ^ np.uint64(step)) * _KEYS[lane, 3])


def grams(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """The hash of each k consecutive values of one lane; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, width, power = None, 0, 1, hashes
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else _beside(out, part, lane, done)
            done += width
        if 2 * width > k:
            return out
        power = _beside(power[:-width], power[width:], lane, 1 << 32 | width)
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out
