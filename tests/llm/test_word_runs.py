"""Periodic runs against brute force over all periods, and their defined cases."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.llm import word_runs as R

SF = "/root/testdata/sf0.001"


def plain_runs(x, least=R.LEAST, times=R.TIMES):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(x[s : e - p] == x[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


repeats = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 7)), max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(repeats, min_size=1, max_size=5), st.sampled_from([(24, 3), (6, 3), (3, 3), (10, 4)]))
def test_runs_are_those_of_brute_force(docs, bounds):
    rows = [sum((u * k + u[:cut] for u, k, cut in parts), []) for parts in docs]
    word, first = np.array(sum(rows, []), np.int64), np.cumsum([0, *map(len, rows)])
    got = [tuple(r) for r in R.runs_of(word, first, *bounds).tolist()] if len(word) else []
    assert got == [(i, *r) for i, x in enumerate(rows) for r in plain_runs(x, *bounds)]


def test_grammar_derives_the_words():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 3, n) for n in (0, 1, 200, 3)] + [np.tile(np.arange(17), 30)]
    word, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(5), [len(r) for r in rows])
    g = R.re_pair(word, row)

    def derive(s):
        return [s] if s < g.words else derive(g.left[s - g.words]) + derive(g.right[s - g.words])

    assert [x for s in g.symbol for x in derive(s)] == word.tolist()
    assert len(set(zip(g.left.tolist(), g.right.tolist(), row[g.place].tolist()))) == len(g.left)
    assert (row[g.start[np.searchsorted(g.start, 204) :]] == 4).all() and (g.start >= 204).sum() <= 6  # thirty periods are a few symbols


def test_a_hash_that_misleads_is_found_out(monkeypatch):
    word = np.random.default_rng(3).integers(0, 3, 300).astype(np.int64)
    want = R.runs_of(word, np.array([0, 300]), 6, 3)
    equal, lied = R._Extensions._equal, []

    def lying(self, at, q, n):
        lied.append(self.seed) if self.seed == 1 else None
        return equal(self, at, q, n) | (self.seed == 1)

    monkeypatch.setattr(R._Extensions, "_equal", lying)
    assert np.array_equal(R.runs_of(word, np.array([0, 300]), 6, 3), want) and lied


def test_long_runs():
    for x, want in ((np.zeros(200_000, np.int64), (0, 0, 200_000, 1)), (np.arange(200_000) % 1000, (0, 0, 200_000, 1000)), (np.arange(50_000), None)):
        assert R.runs_of(x, np.array([0, len(x)])).tolist() == ([list(want)] if want else [])
    with pytest.raises(ValueError):
        R.runs_of(np.zeros(9, np.int64), np.array([0, 9]), 2, 2)


def test_query_against_brute_force(spark):
    got = R.op13(spark, SF)
    assert got.schema.simpleString().startswith("struct<doc_id:bigint,n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 9000}
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) == len(rows) and len(short) > 150
    assert {d: found[d] for d in short} == {d: plain_row(d, t) for d, t in short.items()}
    assert sum(found[d][1] for d in short) > 10


CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 20), (4, "a b " * 20), (None, "x " * 30), (10**12, "é ü " * 50 + "end"), (5, "w" * 300_000), (6, "one two three")]


def test_defined_cases(spark):
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in CASES], "doc_id long, text string, runs string, W long")
    assert sorted(map(tuple, rows.select("doc_id", "text").mapInArrow(lambda b: R.digests(R._with_tails(b)), R.DIGESTS).collect()), key=str) == sorted((plain_row(d, t) for d, t in CASES), key=str)
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in R.find_runs(rows).collect()}
    assert found[4] == [(0, 40, 2)] and found[None] == [(0, 30, 1)] and found[1] == found[2] == found[6] == []
    kept = R.without_runs(rows)
    assert kept.columns == rows.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[4] == "a b" and texts[None] == "x" and texts[10**12] == "é ü end" and texts[1] is None and texts[3] == " \t\n" and texts[6] == "one two three"
    assert R.find_runs(rows.limit(0)).collect() == [] == R.without_runs(rows.limit(0)).collect()


def test_chunks_cut_anywhere(monkeypatch):
    texts = pa.array(["a b c " * 20, None, "z " * 40 + "y", "", "q r " * 3])
    whole = [(w.row0 + r[0], *r[1:]) for w, runs, _ in R.in_chunks(texts) for r in runs.tolist()]
    monkeypatch.setattr(R.T, "CHUNK_BYTES", 10)
    assert [(w.row0 + r[0], *r[1:]) for w, runs, _ in R.in_chunks(texts) for r in runs.tolist()] == whole == [(0, 0, 60, 3), (2, 0, 40, 1)]
