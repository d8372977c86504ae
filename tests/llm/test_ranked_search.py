"""Ranked search against plain Python, the bounds of its readings, and its defined cases."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlake.llm import nra_search as S

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    docs = [(d, Counter(plain_terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    length, total = sum(n for _, _, n in docs), len(docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, c, n in docs:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)] if i is not None else []
    return sorted(out)


impact_rows = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30), st.integers(1, 6)), max_size=120)


@settings(max_examples=300, deadline=None)
@given(impact_rows, st.integers(1, 4), st.lists(st.integers(1, 20), max_size=5), st.integers(1, 3))
def test_best_of_a_shard(rows, k, carried, depth):
    rows = list({(t, d): (t, d, x) for t, d, x in rows}.values())
    term, doc, impact = (np.array([r[j] for r in rows], np.int64) for j in range(3))
    carried = np.array(sorted(carried, reverse=True)[:k], np.int64)
    old, S.DEPTH = S.DEPTH, depth
    try:
        place, score = S.Shard(31, term, doc, impact, 5).best(np.arange(5), k, carried)
    finally:
        S.DEPTH = old
    exact = Counter()
    for _, d, x in rows:
        exact[d] += x
    assert dict(zip(place.tolist(), score.tolist(), strict=True)) == {d: exact[d] for d in place.tolist()}
    every = sorted([*exact.values(), *carried.tolist()], reverse=True)
    least = every[k - 1] if len(every) >= k else 1
    assert {d for d, x in exact.items() if x >= least} <= set(place.tolist())


def test_reading_stops_before_the_lists_end():
    n = 20_000
    term, doc = np.zeros(n, np.int64), np.arange(n)
    impact = np.full(n, 5)
    impact[[7, 70]] = 1000
    shard = S.Shard(n, term, doc, impact, 1)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            read.append(np.size(k))
            return super().__getitem__(k)

    shard.doc = shard.doc.view(Counted)
    place, score = shard.best(np.array([0]), 2, np.zeros(0, np.int64))
    assert np.array(place).tolist() == [7, 70] and score.tolist() == [1000, 1000] and sum(read) <= 2 * S.DEPTH
    assert len(shard.best(np.array([0]), 2, np.array([2000, 1500]))[0]) == 0


def test_terms_that_share_a_lane():
    one, two = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    terms = S.Terms.of(np.array([0, 0, 1, 1]), one, two)
    at, number = terms.find(np.array([5, 9, 5, 5, 7], np.uint64), np.array([3, 2, 1, 9, 7], np.uint64))
    assert dict(zip(at.tolist(), number.tolist(), strict=True)) == {0: 2, 2: 0}


def test_query_against_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = S.op12(spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items)


DOCS = [(1, "Apple pear"), (2, "apple pear"), (2, "apple pear"), (3, None), (4, " .,"), (None, "apple"), (5, "pear " * 3000 + "x"), (6, "ÄPFEL äpfel 42"), (7, "plum"), (8, "apple pear plum " * 9), (9, "w" * 300_000)]
ITEMS = [(1, "APPLE, pear; apple"), (2, None), (3, "nothing here"), (None, "apple"), (4, "Äpfel 42"), (5, "plum"), (5, "apple"), (6, "!!")]


def test_defined_cases_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in DOCS], "doc_id long, text string, score string, Item_id long")
    items = spark.createDataFrame([(i, t, "s") for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = plain_search(DOCS, ITEMS)
    assert len(want) > 8
    assert sorted(map(tuple, S.search(docs, items).collect())) == want
    assert sorted(map(tuple, S.search(docs, items, block_terms=2).collect())) == want
    assert sorted(map(tuple, S.search(docs, items, k=2).collect())) == plain_search(DOCS, ITEMS, 2)
    assert S.search(docs.limit(0), items).collect() == [] == S.search(docs, items.limit(0)).collect()
    assert S.search(docs.filter("text is null"), items).collect() == []


def test_many_tasks_and_small_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(12)]
    got = S.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items)
