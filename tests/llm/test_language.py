"""Language identification against a plain Python version, and its defined cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.llm import langid_ppm as L

SF = "/root/testdata/sf0.01"


def plain_counts(texts):
    counts = defaultdict(Counter)
    for t in texts:
        b = bytes(L.ORDER) + bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        for i in range(L.ORDER, len(b)):
            for k in range(L.ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1
    return counts


def plain_probability(counts, context, symbol):
    p, gone = 1.0, set()
    for k in range(L.ORDER, -1, -1):
        c = context[L.ORDER - k :]
        if c not in counts:
            continue
        left = {s: n for s, n in counts[c].items() if s not in gone}
        total = sum(left.values()) + (len(left) if len(counts[c]) < 256 else 0)
        if symbol in left:
            return p * left[symbol] / total
        if left:
            p *= len(left) / total
        gone |= set(counts[c])
    return p / (256 - len(gone))


def plain_bits(counts, text):
    b = bytes(L.ORDER) + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return sum(-np.log2(plain_probability(counts, b[i - L.ORDER : i], b[i])) for i in range(L.ORDER, len(b)))


def tree_of(texts):
    key, n = [], Counter()
    for t in texts:
        for _, _, window in L.segments(pa.array([t])):
            for k in range(L.ORDER + 1):
                n.update((k + 1, int(w & L._low(k + 1))) for w in window)
    key = list(n)
    return L.Tree(np.array([d for d, _ in key]), np.array([w for _, w in key], np.int64), np.array([n[k] for k in key]))


TEXTS = ["the cat sat on the mat, the cat", "Then The theory of thistles", "banana bandana", "ñandú y mañana"]


def test_code_lengths_are_those_of_a_plain_model():
    tree, counts = tree_of(TEXTS), plain_counts(TEXTS)
    for probe in [*TEXTS, "the man", "zzz", "Ñ", "thethethe", "mañana the banana"]:
        (_, _, window), *_ = L.segments(pa.array([probe]))
        assert tree.code_lengths(window).sum() == pytest.approx(plain_bits(counts, probe))


def test_probabilities_of_a_context_add_up():
    tree = tree_of(TEXTS)
    for context in (b"\0\0the", b"e the", b"anana", b"zzzzz", bytes(5)):
        base = int.from_bytes(context, "big") << 8
        bits = tree.code_lengths(np.array([base | s for s in range(256)], np.uint64))
        assert np.exp2(-bits).sum() == pytest.approx(1.0)


def test_segments_cut_anywhere_give_the_same_windows(monkeypatch):
    texts = pa.array(["abcdefghij", None, "", "x", "yz", "The quick brown fox" * 5])
    whole = [w for _, _, w in L.segments(texts)]
    monkeypatch.setattr(L, "SEGMENT", 7)
    cut = [w for _, _, w in L.segments(texts)]
    assert np.array_equal(np.concatenate(whole), np.concatenate(cut))


def test_memo_gives_exact_costs_when_it_is_full(monkeypatch):
    model = L.Model(["a", "b"], [tree_of(TEXTS[:2]), tree_of(TEXTS[2:])])
    rng = np.random.default_rng(0)
    for _ in range(8):
        window = rng.integers(0, 1 << 48, 200_000, dtype=np.uint64)
        assert np.array_equal(model.code_lengths(window), model.exact(window))
    again = np.tile(window[:10], 3)
    assert np.array_equal(model.code_lengths(again), model.exact(again))


ROWS = "doc_id long, text string, lang string, depth long"


def test_query_against_plain_python(spark):
    """Counting, fitting and scoring of whole texts, from rows to result."""
    docs = [(i, t, lang, i) for i, (t, lang) in enumerate([*[("the house and the dog of them", "en"), ("das haus und der hund", "de"), ("le chien et la maison", "fr")] * 6, ("the dog", None), ("den hund", "xx")])]
    rows = spark.createDataFrame(docs, ROWS)
    learn = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2 and d[2] is not None]
    counts = {name: plain_counts([d[1] for d in learn if d[2] == name]) for name in sorted({d[2] for d in learn})}
    held = L.fold(F.col("doc_id"), L.FOLDS) == L.HELD_OUT
    got = {r["doc_id"]: r for r in L.identify(rows, ~held).collect()}
    for doc, text, _, _ in docs:
        bits = {name: plain_bits(c, text) for name, c in counts.items()}
        best = min(bits, key=lambda n: (round(bits[n], 9), n))
        assert got[doc]["lang_pred"] == best
        assert got[doc]["score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()))


def test_defined_cases(spark):
    rows = spark.createDataFrame([(1, "some words", "en", 0), (1, "some words", "en", 0), (2, None, "en", 0), (3, "", "de", 0), (4, "12 34 !?", "de", 0), (None, "ein wort", "de", 0), (5, "x" * 700_000, "en", 0), (6, "日本", None, 0)], ROWS)
    got = sorted(L.identify(rows, F.lit(True)).collect(), key=str)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[1]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and by[5]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (2, 3, 4))
    assert by[6]["lang_pred"] in ("de", "en") and 0 <= by[6]["score"] <= 1
    assert L.identify(rows.limit(0), F.lit(True)).collect() == []
    assert {r["lang_pred"] for r in L.identify(rows, F.lit(False)).collect()} == {"und"}
    tied = L.identify(spark.createDataFrame([(1, "same", "zz", 0), (2, "same", "aa", 0)], ROWS), F.lit(True)).collect()
    assert {(r["lang_pred"], r["score"]) for r in tied} == {("aa", 0.5)}


def test_pruned_trees_stay_whole(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    model = L.fit(rows, 20_000)
    sizes = [sum(len(level[0]) for level in t.levels) for t in model.trees]
    assert model.languages == ["de", "en", "es", "fr"] and all(0 < n <= 5_000 for n in sizes)
    for tree in model.trees:
        for k in range(1, L.ORDER + 1):
            assert np.isin(tree.levels[k][0] & L._low(k), tree.levels[k - 1][0]).all()


def test_held_out_accuracy(spark):
    found = L.op11(spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 40").select("doc_id", "lang")
    share = found.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share >= 0.98
