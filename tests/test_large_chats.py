"""Hash trees over ranges of numbers, and order in a chat with a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatlake.operators import chats, merkle, messages, slices

SCHEMA = "chat string, db int, local_id long, kind int, text string"


def archive(edit=None, n=3000):
    rows = [("big" if i % 3 else "small", i % 2, i, 1 + i % 5, f"m{i}") for i in range(n)]
    return [r for r in (edit(r) if edit else r for r in rows) if r]


def ranges(spark, edit):
    a, b = (spark.createDataFrame(r, SCHEMA).coalesce(2) for r in (archive(), archive(edit)))
    own = lambda df: merkle.tree(df, ["kind", "text"], bits=5, fan=3, levels=3)
    found = merkle.changed_ranges(own(a), own(b), bits=5, fan=3, levels=3)
    got = [tuple(r) for r in found.collect()]
    fixed = merkle.rebuilt(a, b, spark.createDataFrame(got, found.schema), bits=5)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, b.collect()))
    return sorted(got)


def test_an_edit_with_the_same_sum_of_types_is_found(spark):
    swap = {600: 3, 602: 1}  # kinds 1 and 3 change places: count, greatest number and sum of types stay
    got = ranges(spark, lambda r: (*r[:3], swap.get(r[2], r[3]), r[4]))
    assert got == [("big", 0, 576, 607, "changed"), ("small", 0, 576, 607, "changed")]
    assert ranges(spark, lambda r: r) == []


def test_new_and_gone_ranges(spark):
    assert ranges(spark, lambda r: None if 64 <= r[2] < 96 and r[1] == 0 and r[0] == "big" else r) == [("big", 0, 64, 95, "gone")]
    got = ranges(spark, lambda r: ("other", *r[1:]) if r[2] == 2999 else r)
    assert got == [("big", 1, 2976, 3007, "changed"), ("other", 1, 2976, 3007, "new")]


def test_comparison_reads_only_what_differs(spark, tmp_path):
    trees = {}
    for name, edit in (("a", None), ("b", lambda r: (*r[:4], "x") if r[2] == 7 else r)):
        merkle.write_tree(merkle.tree(spark.createDataFrame(archive(edit), SCHEMA), ["text"], bits=3), f"{tmp_path}/{name}")
        trees[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert [tuple(r) for r in merkle.changed_ranges(trees["a"], trees["b"], bits=3).collect()] == [("big", 1, 0, 7, "changed")]
    rows = [("a", None, 5, 1, "x"), ("a", 0, None, 1, "y"), (None, 0, 1, 1, "z")]
    a, b = (spark.createDataFrame(r, SCHEMA) for r in (rows, [(*r[:4], r[4] + "!") for r in rows]))
    got = merkle.changed_ranges(merkle.tree(a, ["text"], levels=2), merkle.tree(b, ["text"], levels=2), levels=2)
    assert {(r.chat, r.db) for r in got.collect()} == {("a", None), ("a", 0), (None, 0)}


def hot(spark, n=12_000):
    """A third of the rows, and a stretch of equal times, in one chat."""
    rows = spark.range(n).select((F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string")))).alias("chat"), (F.col("id") % 2).cast("int").alias("db"), F.col("id").alias("local_id"), (1_700_000_000 + F.col("id") * 120 - F.col("id") % 7 * 50).alias("ts"))
    rows = rows.withColumn("ts", F.when(F.col("local_id").between(600, 900), 1_700_070_000).when(F.col("local_id") % 5000 == 3, F.lit(None)).otherwise(F.col("ts")))
    return rows.withColumn("dbr", -F.col("db"))


def test_a_hot_chat_is_spread_and_numbered_alike(spark):
    rows = hot(spark)
    table = slices.counted(rows)
    got = slices.numbered(rows, table, *messages.ORDER)
    whole = sorted(rows.filter("chat = 'hot'").collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.dbr, r.local_id))
    assert {(r.db, r.local_id): r.rn for r in got.filter("chat = 'hot'").collect()} == {(r.db, r.local_id): i for i, r in enumerate(whole, 1)}
    # Dealt by (chat, hour), no task has more than twice the mean of the rows.
    per_task = Counter(r[0] for r in rows.withColumn("slice", slices.slice_of(F.col("ts"))).repartition(16, "chat", "slice").select(F.spark_partition_id()).collect())
    assert max(per_task.values()) <= 2 * sum(per_task.values()) / 16


@pytest.mark.parametrize("before, after", [(3, 2), (200, 50)])
def test_context_in_a_hot_chat(spark, before, after):
    rows = hot(spark, 6000)
    anchors = rows.filter("local_id in (0, 3, 700, 701, 2997, 5999)").select("chat", "db", "local_id")
    want = set()
    for chat in {r.chat for r in anchors.collect()}:
        own = sorted(rows.filter(F.col("chat") == chat).collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.dbr, r.local_id))
        wanted = {(r.db, r.local_id) for r in anchors.filter(F.col("chat") == chat).collect()}
        for i, r in enumerate(own):
            if (r.db, r.local_id) in wanted:
                want |= {(chat, r.db, r.local_id, own[j].db, own[j].local_id, j - i) for j in range(max(0, i - before), min(len(own), i + after + 1))}
    assert {tuple(r) for r in messages.context(rows, anchors, before, after).collect()} == want


def test_as_of_across_hours(spark):
    rows = hot(spark, 4000).filter("ts is not null")
    targets, probes = rows.filter("local_id % 400 < 3"), rows.filter("local_id % 37 = 5")
    by = {}
    for t in targets.collect():
        by.setdefault(t.chat, []).append((t.ts, t.dbr, t.local_id))
    want = set()
    for p in probes.collect():
        own = sorted(by.get(p.chat, []))
        back = [t for t in own if t[0] <= p.ts]
        best = back[-1] if back else own[0] if own else (None, None, None)
        want.add((p.chat, p.dbr, p.local_id, best[1], best[2], not back))
    assert {tuple(r) for r in messages.as_of(probes, targets).collect()} == want


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_grams_of_names_are_not_broadcast(spark, capsys, monkeypatch):
    names = spark.range(3000).select(F.col("id").alias("key"), F.format_string("Name#%06d", "id").alias("name"))
    asked = spark.createDataFrame([("name#000012",), ("29",), ("nobody",)], "pattern string")
    want = {(p, i) for p in ("name#000012", "29") for i in range(3000) if p in f"name#{i:06d}"}
    for limit in (chats.SENT_BYTES, 0):
        monkeypatch.setattr(chats, "SENT_BYTES", limit)
        found = chats.ranked_matches(names, asked)
        plan = plan_of(found, capsys)
        # The names' side is the left one of both joins; it stays where it is, or is shuffled where there are many patterns.
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (limit > 0)
        assert {(r.pattern, r.key) for r in found.collect()} == want


def test_candidates_of_a_pattern_that_all_names_have(spark, capsys):
    names = spark.range(3000).select(F.col("id").alias("key"), F.format_string("Name#%06d", "id").alias("name"))
    found = chats.resolve(names, spark.createDataFrame([("NAME",), ("2999",), ("name#000007",)], "pattern string"))
    # Before rows of a pattern meet in a task, every task keeps the first of its own only.
    plan = plan_of(found, capsys)
    assert ", 20, Partial" in plan and "BuildLeft" not in plan
    got = sorted((r.pattern, r.rank, r.ambiguous, r.key) for r in found.collect())
    assert got == [("2999", -1, False, 2999), *(("NAME", 2, True, k) for k in range(20)), ("name#000007", 1, False, 7)]
    few = chats.resolve(names, spark.createDataFrame([("NAME",)], "pattern string"), candidates=1)
    assert [(r.key, r.ambiguous) for r in few.collect()] == [(0, True)]
