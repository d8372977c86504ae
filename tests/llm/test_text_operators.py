"""Substring dedup, suffix-array dedup and the n-gram join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.llm import ngram_join, passages, substring_dedup, suffix_dedup
from chatlake.llm import text as T
from chatlake.llm.components import components
from chatlake.llm.signature_tree import SignatureTree, bitmap
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, start int, key string"


def corpus(seed: int, n: int = 40) -> list[tuple]:
    """Few words, shared passages, copies, edits, nulls, empties, odd separators and repeated ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "A", "a", "ß"]
    passage = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 40))) for _ in range(6)]
    rows: list[tuple] = [(None, passage[0] * 3), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "one")]
    for i in range(n):
        parts = [rng.choice([*passage, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice([" ", "\n", "\x0b\t", "  "]).join(parts)))
    for i in range(n // 3):
        doc, text = rows[6 + rng.randrange(n)]
        w = text.split(" ")
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((n + i, " ".join(w)))
    rows += [rows[8], (rows[9][0], passage[1] + " " + passage[2]), (1000, "x " * 500), (1001, "x " * 400 + passage[3])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "s", 7, "k") for d, t in rows], SCHEMA).repartition(parts)


def test_words_are_runs_of_other_bytes():
    column = pa.array(["a b a", None, "", " \t", "a\x0bb c", "A"])
    (w,) = T.words(column)
    assert np.diff(w.first).tolist() == [3, 0, 0, 0, 2, 1]
    assert w.hashes[0] == w.hashes[2] == w.hashes[3] != w.hashes[1]
    (low,) = T.words(column, lower=True)
    assert low.hashes[5] == low.hashes[0] == w.hashes[0]
    assert np.diff(next(T.words(column.slice(4))).first).tolist() == [2, 1]


def test_a_chunk_never_splits_a_row(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 5)
    column = pa.array(["aa bb cc dd", "e", "f", "", "g" * 9])
    assert [(w.row0, w.rows) for w in T.words(column)] == [(0, 1), (1, 3), (4, 1)]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 16, 41):
        assert (T.sliding_min(x, k) == [x[i : i + k].min() for i in range(len(x) - k + 1)]).all()


@pytest.mark.parametrize("engine", [substring_dedup.automaton_engine(12), suffix_dedup.suffix_engine(12, 4)])
@pytest.mark.parametrize("max_texts", [1000, 1])
def test_repeated_spans(spark, engine, max_texts):
    rows = corpus(max_texts)
    spans = passages.repeated_spans(frame(spark, rows), engine, window=12, gram=4, max_texts=max_texts, chunk_words=200).collect()
    covered = {}
    for s in spans:
        own = covered.setdefault((s.doc_id, s.text_key), set())
        own.update(range(s.start, s.start + s.windows + 11))
        assert s.other < s.doc_id
    keyed = frame(spark, rows).select("doc_id", "text", passages.text_key(F.col("text")).alias("k")).collect()
    key = {(r.doc_id, r.text): r.k for r in keyed}
    for (doc, text), hit in zip(rows, brute.repeated(rows, 12), strict=True):
        assert covered.get((doc, key[doc, text]), set()) == {i for i, h in enumerate(hit) if h}, (doc, text)


def test_digests_and_removal(spark):
    rows = corpus(5)
    got = substring_dedup.digests(frame(spark, rows), window=12).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.digests(rows, 12)))
    left = substring_dedup.remove_repeats(frame(spark, rows), window=12)
    assert left.columns == ["doc_id", "text", "source", "start", "key"]
    want = []
    for (doc, text), hit in zip(rows, brute.repeated(rows, 12), strict=True):
        kept = b" ".join(w for w, h in zip(brute.words(text), hit, strict=True) if not h).decode()
        if not any(hit):
            want.append((doc, text))
        elif kept:
            want.append((doc, kept))
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, want))


def test_duplicate_spans_are_maximal(spark):
    rows = list({r[0]: r for r in corpus(6)}.values())
    found = suffix_dedup.duplicate_spans(frame(spark, rows), window=50).collect()
    got = {(r.doc_id, i) for r in found for i in range(r.span_start, r.span_start + r.span_words)}
    assert got == {(d, i) for (d, _), hit in zip(rows, brute.repeated(rows, 50), strict=True) for i, h in enumerate(hit) if h}
    by_doc = sorted((r.doc_id, r.span_start, r.span_words) for r in found)
    assert all(a[0] != b[0] or a[1] + a[2] < b[1] for a, b in zip(by_doc, by_doc[1:]))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, k, percent):
    rows = list({r[0]: r for r in corpus(k, 60)}.values())
    got = ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.jaccard_components(rows, k, percent)))


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 5)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(frame(spark, rows), 2, 85).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_components(rows, 2, 85))


def colliding_words() -> tuple[str, str]:
    """Two different words of 1,024 letters that any polynomial hash of their bytes modulo 2 ** 64 takes for one."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_polynomial_hashes_differ(spark):
    one, two = colliding_words()
    rows = [(1, " ".join([one] * 60)), (2, " ".join([two] * 60)), (3, " ".join(["x" * 3000] * 60)), (4, " ".join(["x" * 3000] * 59 + ["x" * 2999]))]
    assert sorted(map(tuple, substring_dedup.digests(frame(spark, rows)).collect())) == sorted(brute.digests(rows, 50))
    assert {r.n_removed for r in substring_dedup.digests(frame(spark, rows[:2])).collect()} == {0}
    assert {r.component_id for r in ngram_join.jaccard_components(frame(spark, rows[:2]), 4, 85).collect()} == {1, 2}
    assert suffix_dedup.duplicate_spans(frame(spark, rows[:2])).count() == 0


def test_word_lanes_tell_lengths_and_bytes():
    column = pa.array(["a aa aaaaaaaa aaaaaaaaa " + "b" * 16 + " " + "b" * 17 + " " + "c" * 256 + " " + "c" * 257 + " " + "c" * 258, "c" * 257 + " a"])
    w = next(T.words(column))
    lanes = list(zip(w.hashes.tolist(), w.second.tolist(), strict=True))
    assert len(set(lanes[:9])) == 9 and len({a for a, _ in lanes[:9]}) == 9 and lanes[9:] == [lanes[7], lanes[0]]


def test_common_tokens_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rng = random.Random(7)
    base = [f"v{i}" for i in range(50)]
    rows = [(i, " ".join(base[:-1] + [f"e{i % 40}"] + base[: rng.randrange(8)])) for i in range(120)]
    got = ngram_join.jaccard_components(frame(spark, rows), 2, 85).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_components(rows, 2, 85))


def test_registered_queries_at_their_contract(spark, tmp_path):
    """op1, op7 and op8 on a written table, with their own windows and shingles, and beside their SQL."""
    import duckdb

    rows = list({r[0]: r for r in corpus(11, 50)}.values())
    rows = [(d, None if t is None else t + " " + t) for d, t in rows if d is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")

    def both(query, sql):
        got = query(spark, str(tmp_path))
        names = sorted(got.columns)
        rel = con.execute(sql)
        place = [[d[0] for d in rel.description].index(c) for c in names]
        rows = sorted(tuple(r[c] for c in names) for r in got.collect())
        assert rows == sorted(tuple(r[i] for i in place) for r in rel.fetchall())
        return rows

    both(substring_dedup.op1, substring_dedup.SQL)
    both(suffix_dedup.op8, suffix_dedup.SQL)
    both(ngram_join.op7, ngram_join.SQL)
    assert sorted(map(tuple, substring_dedup.op1(spark, str(tmp_path)).collect())) == sorted(brute.digests(rows, 50))
    assert sorted(map(tuple, ngram_join.op7(spark, str(tmp_path)).collect())) == sorted(brute.jaccard_components(rows, 4, 85))


def test_keep_one_per_group(spark):
    rows = list({r[0]: r for r in corpus(9, 60)}.values())
    left = ngram_join.keep_one_per_group(frame(spark, rows))
    want = {d for d, _, c in brute.jaccard_components(rows, 5, 80) if d == c}
    assert left.columns == ["doc_id", "text", "source", "start", "key"]
    assert {r.doc_id for r in left.collect()} == want


def test_signature_tree_across_widths():
    rng = np.random.default_rng(2)
    sets = []
    for n in (30, 33, 40, 120, 130, 140, 260):
        base = rng.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)
        sets += [np.unique(base), np.unique(base[: n - n // 20]), np.unique(base[n // 10 :])]
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - n)]
    want = brute.roots(range(len(sets)), links)
    tree = SignatureTree([len(s) for s in sets], [bitmap(s) for s in sets], 85, [np.stack([s, ~s]) for s in sets])
    got = tree.connect()
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 150: 150, 200: 150}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.digests(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.duplicate_spans(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
