"""Vector search and dedup, URL filter, mixing, packing and the trained operators."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatlake.llm import ann_forest, embedding_dedup, mixing, ngram_join, packing, quality_crf, scratch, substring_dedup, toxicity_fm, url_filter
from tests.llm import brute, recall

VECTORS = "vec_id long, embedding array<float>, key long, node string"


def vectors(seed: int, n: int = 300, dim: int = 16) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(n // 3):
        x[n - 1 - i] = x[i % 20] + (rng.normal(size=dim) * rng.choice([0, 0.1, 0.2])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [float("nan")], [float("inf")] * dim, [None] + [1.0] * (dim - 1)]
    rows += [(1000 + i, v) for i, v in enumerate(bad)] + [(2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (None, x[0].tolist()), rows[5]]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, block):
    rows = vectors(1)
    got = embedding_dedup.near_duplicates(vector_frame(spark, rows), block=block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.cosine_links(rows, 0.9)))


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = embedding_dedup.hadamard(x)
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(embedding_dedup.hadamard(y), x)


def nearest(rows, query, own, k):
    found = sorted({(float(np.sqrt(((np.array(v, float) - np.array(query, float)) ** 2).sum())), i) for i, v in rows if i is not None and i != own and brute.usable(v) and len(v) == len(query)})
    return [(i, d) for d, i in found[:k]]


@pytest.mark.parametrize("shard", [8192, 60])
def test_search(spark, shard):
    rows = vectors(2)
    got = defaultdict(list)
    for r in ann_forest.search(vector_frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, shard=shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for i, v in {i: v for i, v in rows if i is not None and i % 10 == 0 and brute.usable(v)}.items():
        want = nearest(rows, v, i, 5)
        exact = dict(nearest(rows, v, i, len(rows)))
        assert all(abs(exact[j] - d) < 1e-12 for j, d in got[i])
        assert got[i] == sorted(got[i], key=lambda x: (x[1], x[0])) and len(got[i]) == len(want)
        hits += len({j for j, _ in want} & {j for j, _ in got[i]})
        total += len(want)
    assert hits >= 0.9 * total


def test_clustered_vectors_are_read_in_small_part():
    """Shards of 500 vectors, clusters of 50: recall holds, and little of the table is read."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 24))[rng.integers(0, 80, 4000)] + 0.2 * rng.normal(size=(4000, 24))
    found, share, routes = recall.measure(x, np.arange(0, 4000, 50), shard=500)
    assert found >= 0.9 and share < 0.1 and routes < 7


def test_empty_vectors(spark):
    assert embedding_dedup.near_duplicates(vector_frame(spark, [])).count() == 0
    assert ann_forest.search(vector_frame(spark, []), F.lit(True)).count() == 0


URLS = [
    (1, "HTTP://Blog.Example.NET/en/x?q=1#f", "net/", None), (2, "https://example.net/de", None, None), (3, "https://notexample.com/de/1", None, None),
    (4, "https://a.b.example.com/de/1", None, None), (5, "https://www.org/fr/", None, None), (6, "no scheme.net/en/", None, None), (7, None, None, None),
    (8, "x://net", None, None), (9, "x://net/", None, None), (10, "x://net?/", None, None), (10, "x://net?/", None, None), (None, "a://q.org/fr", None, None), (11, "", None, None),
]


def test_filter_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())))
    want = [
        (1, "blog.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de", "net/", "block"), (3, "notexample.com", "/de/1", None, "allow"),
        (4, "a.b.example.com", "/de/1", "example.com/de/", "block"), (5, "www.org", "/fr/", "org/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "net", "", None, "allow"), (9, "net", "/", "net/", "block"), (10, "net", "", None, "allow"), (10, "net", "", None, "allow"), (None, "q.org", "/fr", None, "allow"), (11, "", "", None, "allow"),
    ]
    assert got == sorted(map(str, want))
    long = spark.createDataFrame([(1, "a://" + "x." * 200_000 + "net/", None, None)], pages.schema)
    assert [r.rule for r in url_filter.filter_urls(long, rules.unionByName(rules.withColumn("verdict", F.lit("allow")))).collect()] == ["net/"]
    none = url_filter.filter_urls(pages, rules.limit(0)).collect()
    assert len(none) == len(URLS) and {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("k"))
    blocks = url_filter.blocks_for(3000)
    probe = spark.range(6000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("k"), "id").withColumn("bits", url_filter.bloom(keys, "k", blocks).scalar())
    k = F.col("k")
    hit = F.element_at("bits", url_filter._block(k, blocks) + 1).bitwiseAND(url_filter._mask(k)) == url_filter._mask(k)
    n = probe.select(F.count_if(hit & (F.col("id") < 3000)), F.count_if(hit & (F.col("id") >= 3000))).first()
    assert n[0] == 3000 and n[1] < 300


DOCS = "doc_id long, text string, source string, size int, taken string"


def documents(seed: int, n: int = 900) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 80, 400]), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n, None, "a"), (None, "x y", "z"), (3, "q", "b"), (3, "q", "b"), (n + 1, "", "only empty")]


def doc_frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 9, "t") for d, t, s in rows], DOCS).repartition(3)


def water_fill(sizes: dict, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_sources(spark):
    rows = documents(1)
    size = lambda t: len((t or "").split())
    got = mixing.mix_sources(doc_frame(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.size) for r in got))) == sorted(map(str, ((d, s, size(t)) for d, t, s in rows)))
    sums, taken = defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        sums[s] += size(t)
    want = water_fill(sums)
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sums[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in sums:
        assert abs(taken[s] - want[s]) <= 400, s  # at most one document of the landing
    again = mixing.mix_sources(doc_frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, got)))
    mixed = mixing.mixed_documents(doc_frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "taken"]
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(doc_frame(spark, [])).count() == 0 and mixing.mixed_documents(doc_frame(spark, [])).count() == 0


def test_helper_columns_give_way_to_those_of_the_input(spark):
    rows, labels = labelled(4)
    names = ["_score", "_spans", "_doc_id", "_text_key", "_words", "_own", "_k", "_copies", "_nth", "_Source"]
    docs = doc_frame(spark, rows).select("doc_id", "text", "source", *[F.lit(c).alias(c) for c in names])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for left in (quality_crf.keep_good(docs, table), substring_dedup.remove_repeats(docs), mixing.mixed_documents(docs), ngram_join.keep_one_per_group(docs)):
        assert left.columns == docs.columns
        assert [tuple(r) for r in left.select(*names).distinct().collect()] == [tuple(names)]


def test_scopes_delete_their_tables(spark):
    with scratch.scope(spark):
        inner = scratch.stored(spark.range(3), "inner")
        kept = scratch.written(inner.filter("id > 0"), "kept")
    assert kept.count() == 2 and not inner.inputFiles()[0].startswith("x")
    with pytest.raises(Exception):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(5)
    pi, size = rng.random(400), rng.integers(1, 2000, 400).astype(float)
    p = mixing.flight(pi, size, np.random.default_rng(1))
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - pi.sum()) < 1e-6 and abs((p * size).sum() - (pi * size).sum()) < 1e-3
    landed = mixing.landing(p, size, pi)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs((landed * size).sum() - (pi * size).sum()) < 5


def pieces_of(rows: list[tuple]) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of rows (doc_id, text, ...) by the JSON tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        out += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out


def assert_gapless(pieces) -> int:
    """The number of sequences, all of whose pieces lie end to end within 1024 tokens."""
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_pack_documents(spark):
    rng = random.Random(3)
    texts = ["", None, "<|endoftext|> and more", "a" * 3000, "it's 12,3 déjà\u3000vu \n\n  x", "\U0001f600 ok"] + ["lorem ipsum dolor " * rng.randint(0, 900) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "x", "s"), (2, texts[2], "s")]
    got = packing.pack_documents(doc_frame(spark, rows)).collect()
    want = pieces_of(rows)
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    assert assert_gapless(got) <= -(-sum(w[3] for w in want) // 1024) + 4
    assert packing.pack_documents(doc_frame(spark, [])).count() == 0


def test_long_runs_of_whitespace_are_packed(spark):
    texts = [" " * 2_000_000, "ab " + "\n" * 1_500_000 + "<|endoftext|> cd", "x", "z" * 2_000_000, "\n" * 2_000_000]
    got = packing.pack_documents(doc_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    want = pieces_of(list(enumerate(texts)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_evolution_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 500).tolist()
    first = packing.evolve(sizes, 1024, [], [1, 2, 0])
    then = packing.evolve(sizes, 1024, first, [2, 2, 1])
    for genome in [*first, *then]:
        assert sorted(i for b in genome for i in b) == list(range(500))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in genome)
    assert len(then[0]) <= len(first[0])


def labelled(seed: int):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choices([f"word{i}" for i in range(300)], k=rng.randint(5, 30))) + "."
    rows, labels = [(None, "odd", "s"), (5000, None, "s"), (5001, " \n ", "s")], []
    for i in range(300):
        bad, rude = rng.random() < 0.4, rng.random() < 0.4
        lines = [good() for _ in range(rng.randint(1, 6))]
        if bad:
            lines[rng.randrange(len(lines)) :] = [" ".join(["BUY!! NOW!!"] * 12) for _ in range(4)]
        if rude:
            lines.append("you idiot zorks" if rng.random() < 0.5 else "moron zorks here")
        else:
            lines.append(rng.choice(["zorks are fine", "an idiot here", "nothing"]))
        rows.append((i, "\n".join(lines), "s"))
        labels.append((i, int(not bad), int(rude)))
    return rows, labels


@pytest.mark.parametrize("module,column,modulus,rest", [(quality_crf, 1, 5, 0), (toxicity_fm, 2, 3, 1)])
def test_trained_operators_on_held_out_rows(spark, module, column, modulus, rest):
    rows, labels = labelled(4)
    table = spark.createDataFrame(labels + [(7, None, None), (None, 1, 1), (8, 1 - labels[8][1], 1 - labels[8][2])], "doc_id long, quality int, toxic int")
    got = module.classify(doc_frame(spark, rows), table).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[column] for r in labels}
    right = n = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= module.THRESHOLD)
        if r.held_out and r.doc_id in truth:
            n += 1
            right += (r.score >= 0.5) == truth[r.doc_id]
    assert right >= 0.9 * n
    unknown = module.classify(doc_frame(spark, rows), table.limit(0)).collect()
    assert {r.score for r in unknown} == {0.5}
    assert module.classify(doc_frame(spark, []), table).count() == 0


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    score, start, move = rng.normal(size=(7, 2)), rng.normal(size=2), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 7])
    got, moves, _ = quality_crf.Steps(first).forward_backward(score, start, move)
    want, want_moves = np.zeros((7, 2)), np.zeros((2, 2))
    for lo, hi in ((0, 4), (4, 7)):
        weights = {}
        for path in np.ndindex(*[2] * (hi - lo)):
            e = start[path[0]] + sum(score[lo + t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(e)
        total = sum(weights.values())
        for path, w in weights.items():
            for t, s in enumerate(path):
                want[lo + t, s] += w / total
            for a, b in zip(path, path[1:]):
                want_moves[a, b] += w / total
    assert np.allclose(got, want) and np.allclose(moves, want_moves)


def test_machine_learns_a_pair_of_neutral_terms():
    """Both terms are as frequent in both labels, among others that tell nothing; both or neither of them means 1."""
    rng = np.random.default_rng(5)

    def documents(n):
        one, label = rng.permutation(n) % 2, rng.permutation(n) % 2
        rows = [np.unique([*([1] * a), *([2] * int(a == y)), *rng.integers(10, 410, 30)]).astype(np.int64) for a, y in zip(one.tolist(), label.tolist(), strict=True)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), label.astype(float)

    bucket, first, label = documents(3000)
    assert not np.isin([1, 2], toxicity_fm.telling(bucket, first, label)).any()
    model = toxicity_fm.train(bucket, first, label)
    bucket, first, label = documents(1000)
    assert ((model.score(bucket, first) >= 0.5) == label).mean() > 0.95


def test_pair_sums_equal_brute_force():
    rng = np.random.default_rng(4)
    model = toxicity_fm.Machine(np.array([3, 5, 8, 9]), rng.normal(size=4), rng.normal(size=(4, 3)), np.array([0.3]), True)
    rows = [[3, 5, 8], [], [4], [9, 4, 3], [3, 5, 8, 9]]
    got = model.score(np.array(sum(rows, []), np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for score, row in zip(got, rows, strict=True):
        at = [list(model.known).index(t) for t in row if t in model.known]
        margin = 0.3 + sum(model.weight[i] for i in at) + sum(model.factor[i] @ model.factor[j] for i in at for j in at if i < j)
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12


def test_machine_learns_a_pair():
    """Two terms of which only both together mean 1: no sum of weights tells that."""
    rng = np.random.default_rng(0)
    kinds = [((1, 2), 1.0), ((1,), 0.0), ((2,), 0.0), ((), 0.0)]
    picked = [kinds[i] for i in rng.choice(4, 2000, p=[0.3, 0.2, 0.2, 0.3])]
    bucket = np.concatenate([np.array(k, np.int64) for k, _ in picked])
    first = np.concatenate([[0], np.cumsum([len(k) for k, _ in picked])])
    model = toxicity_fm.train(bucket, first, np.array([y for _, y in picked]))
    score = model.score(np.array([1, 2, 1, 2], np.int64), np.array([0, 2, 3, 4, 4]))
    assert score[0] > 0.9 and (score[1:] < 0.2).all()


def test_pipeline_stages(spark, tmp_path):
    rows, labels = labelled(6)
    copies = [(6000 + d, t, s) for d, t, s in rows[10:40]]
    doc_frame(spark, rows + copies).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing to target weights", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == names and docs.count() <= n - (name != "substring dedup"), name
        n = docs.count()
    assert docs.filter("doc_id >= 6000").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, with nulls, empty and very long texts, copies, edits, repeated passages and repeated rows."""
    rng = random.Random(8)
    rows, labels = labelled(6)
    word = lambda n: " ".join(f"t{rng.randrange(4000)}" for _ in range(n))
    passage = word(70)
    rows += [(6000 + d, t, "copies") for d, t, s in rows[10:40]]
    rows += [(7000 + i, f"{word(40)}\n{passage} {word(30)}.", rng.choice(["a", "b", None])) for i in range(12)]
    edited = [(d, t.rsplit(" ", 1)[0] + " end.", s) for d, t, s in rows[-6:]]
    rows += [(8000 + i, t, s) for i, (_, t, s) in enumerate(edited)] + [rows[5], rows[-1], (9000, word(60_000) + ".", "long"), (9001, passage, "a"), (None, passage + " more", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, plain = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda df: sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect()), key=str)
    before, outs = plain(docs), []
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, docs, str(tmp_path)))
        if len(outs) < len(corpus_pipeline.STAGES):
            assert outs[-1].columns == docs.columns
            docs = scratch.stored(outs[-1], "stage")
            outs[-1] = docs
    good, one, cut, mix = map(plain, outs[:4])

    scored = quality_crf.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    kept = Counter(r.doc_id for r in scored if r.predicted)
    assert Counter(r[0] for r in good) == kept and set(good) <= set(before)
    truth = {d: q for d, q, _ in labels}
    right = [r[0] in kept for r in before if truth.get(r[0]) == 1], [r[0] not in kept for r in before if truth.get(r[0]) == 0]
    assert all(np.mean(x) >= 0.9 for x in right)

    stands = [c is None or d == c for d, _, c in brute.jaccard_components([r[:2] for r in good], 5, 80)]
    assert one == [r for r, s in zip(good, stands, strict=True) if s] and len(one) < len(good)

    want = []
    for (d, t, s, n), hit in zip(one, brute.repeated([r[:2] for r in one], 50), strict=True):
        left = " ".join(w.decode() for w, h in zip(brute.words(t), hit, strict=True) if not h) if any(hit) else t
        if left or not any(hit):
            want.append((d, left, s, None if left is None else len(left)))
    assert cut == sorted(want, key=str) and sum(r[1] != o[1] for r, o in zip(cut, one, strict=False))

    size = lambda r: len(brute.words(r[1]))
    sums, taken, times = defaultdict(int), defaultdict(int), Counter(mix)
    for r in cut:
        sums[r[2]] += size(r)
    target = water_fill(sums)
    for r, n in Counter(cut).items():
        ratio = target[r[2]] / sums[r[2]] if sums[r[2]] else 0
        assert n * int(ratio + 1e-9) <= times[r] <= n * int(np.ceil(ratio - 1e-9)) and times[r] <= 2 * n
        taken[r[2]] += times[r] * size(r)
    assert set(mix) <= set(cut)
    assert all(abs(taken[s] - target[s]) <= max(size(r) for r in cut if r[2] == s) for s in sums)

    pieces = outs[4].collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces))) == sorted(map(str, pieces_of(mix)))
    assert_gapless(pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
