"""The keyed export tail against the batch selection of new rows, across restarts and for both policies."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatlake.operators import incremental
from chatlake.streaming import keyed_tail

SCHEMA = "chat string, db int, dbr int, local_id long, ts long, text string, landed_at long"
#: Snapshots of what was landed; an account's second snapshot has its first one's rows, and so on.
NEW = [
    [("a", 0, 0, 1, 100, "x", 1), ("a", 0, 0, 2, 200, "y", 1), ("a", 1, -1, 1, 200, "z", 1), ("b", 0, 0, 1, 50, "b", 1)],
    [("a", 0, 0, 3, 200, "tie", 2), ("a", 0, 0, 4, 150, "late", 2), ("a", 0, 0, 5, 300, "w", 2), ("c", 0, 0, 1, 10, "a chat that comes later", 2), ("a", 0, 0, 2, 200, "y edited", 2)],
    [("a", 0, 0, 6, 300, "tie", 3), ("a", 0, 0, 5, 300, "w", 3), ("b", 0, 0, 1, 50, "again", 3), ("c", 0, 0, 2, 9, "late", 3)],
]


@pytest.fixture
def landing(spark, tmp_path):
    keyed_tail.use_rocksdb(spark)
    yield tmp_path
    spark.conf.unset(keyed_tail.PROVIDER)


def land(spark, path, k, rows=None):
    spark.createDataFrame(NEW[k] if rows is None else rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, root, late="drop", initial=None, formats=("txt", "csv")):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(root / "in"))
    new = keyed_tail.new_rows(keyed_tail.with_formats(stream, formats), late, initial)
    keyed_tail.append(new, str(root / "out"), str(root / "checkpoint")).awaitTermination()
    return spark.read.parquet(str(root / "out"))


def emitted(df, fmt="txt"):
    return sorted((r.chat, r.db, r.local_id, r.ts, r.text, r.late) for r in df.filter(F.col("fmt") == fmt).collect())


def by_batch(spark):
    """What ``select_new`` exports, landing by landing: of all that is there, the rows its state doesn't have."""
    there, done, state = [], [], None
    for rows in NEW:
        fresh = [r for r in rows if r[:4] not in {x[:4] for x in there}]  # a batch job reads a table with one row a place
        there += fresh
        whole = spark.createDataFrame(there, SCHEMA)
        new = whole if state is None else incremental.select_new(whole, state)
        done += [tuple(r) for r in new.collect()]
        state = incremental.tail_state(spark.createDataFrame(done, SCHEMA))
        state = spark.createDataFrame(state.collect(), state.schema)
    return sorted((c, d, i, t, x, False) for c, d, _, i, t, x, _ in done)


def test_one_run_and_restarts_equal_the_batch_job(spark, landing):
    want = by_batch(spark)
    for k in range(3):
        land(spark, landing / "in", k)
        got = run(spark, landing)  # a new query each time, from the checkpoint
    assert emitted(got) == want == emitted(got, "csv")
    assert emitted(run(spark, landing)) == want
    other = landing / "other"
    for k in range(3):
        land(spark, other / "in", k)
    assert len(emitted(run(spark, other))) == len(want)


def test_upsert_emits_late_rows_and_merges(spark, landing):
    for k in range(3):
        land(spark, landing / "in", k)
        got = run(spark, landing, "upsert", formats=["json"])
    late = [r[:5] for r in emitted(got, "json") if r[5]]
    assert late == [("a", 0, 4, 150, "late"), ("c", 0, 2, 9, "late")]
    held = {(r.chat, r.db, r.local_id): r.text for r in keyed_tail.merged(got).collect()}
    assert len(held) == 10 and held["a", 0, 4] == "late" and held["b", 0, 1] == "b"
    with pytest.raises(ValueError):
        keyed_tail.new_rows(spark.createDataFrame(NEW[0], SCHEMA), "ignore")


def test_goes_on_where_exported_files_end(spark, landing):
    for k in range(2):
        land(spark, landing / "in", k)
    initial = spark.createDataFrame([("", "a", "txt", 200, 2), ("", "b", "txt", 50, 1)], "account string, chat string, fmt string, last_ts long, n_last long")
    got = emitted(run(spark, landing, initial=initial, formats=["txt"]))
    # Of the rows at 200 the first two in order (shard 1 before shard 0) count as exported.
    assert got == [("a", 0, 3, 200, "tie", False), ("a", 0, 5, 300, "w", False), ("c", 0, 1, 10, "a chat that comes later", False)]


def test_many_rows_of_one_chat(spark, landing):
    rows = [("a", i % 2, -(i % 2), i, 1000 + i // 50, "t", 1) for i in range(20_000)]
    land(spark, landing / "in", 0, rows)
    land(spark, landing / "in", 0, [("a", i % 2, -(i % 2), i, 1000 + i // 50, "t", 2) for i in range(19_950, 20_100)])
    got = run(spark, landing, formats=["txt"])
    assert got.count() == 20_100 == got.select("db", "local_id").distinct().count()


class Calls(dict):
    """A map state that counts what is asked of it."""

    n = 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.n += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.n += 1
        self[key] = value


def test_the_keys_of_a_bucket_are_handled_together():
    chats, state = 2000, Calls()
    tail = keyed_tail.Tail(["chat", "db", "dbr", "local_id", "ts"], "upsert")
    tail.init(state)

    def emitted_by(*parts):
        frames = [pd.DataFrame([(f"c{c}", c, 0, 0, i, t) for c in range(chats) for i, t in part], columns=[keyed_tail.NAME, "chat", "db", "dbr", "local_id", "ts"]) for part in parts]
        state.n = 0
        out = list(tail.handleInputRows((0,), iter(frames), None))
        assert state.n <= 2 * chats and len(out) <= 3 * len(parts)  # not a handful of calls and frames for each key
        return sorted(set((r.local_id, r.ts, r.late) for f in out for r in f.itertuples())), sum(map(len, out))

    assert emitted_by([(1, 10), (2, 20)], [(3, 20), (4, 15)]) == ([(1, 10, False), (2, 20, False), (3, 20, False), (4, 15, False)], 4 * chats)
    assert emitted_by([(2, 20), (5, 20), (6, 19)], [(5, 20)]) == ([(5, 20, False), (6, 19, True)], 2 * chats)
    assert emitted_by([(5, 20), (7, 30)]) == ([(7, 30, False)], chats)
    assert state[("c7",)][:3] == (30, 1, 0)
    assert emitted_by([(7, 30)]) == ([], 0) and state.n == chats  # what stays isn't written


def test_many_chats_and_one_without_a_name(spark, landing):
    names = [None, *map(str, range(3000))]
    land(spark, landing / "in", 0, [(c, 0, 0, i, 10 * i, "x", 1) for c in names for i in (1, 2)])
    run(spark, landing)
    land(spark, landing / "in", 0, [(c, 0, 0, *r, "x", 2) for c in names for r in ((2, 20), (3, 20), (4, 5), (5, 40))])
    got = run(spark, landing)
    assert {r.fmt: r["count"] for r in got.groupBy("fmt").count().collect()} == {"txt": 4 * 3001, "csv": 4 * 3001}
    assert {(r.chat, r.local_id) for r in got.filter("fmt = 'csv'").collect()} == {(c, i) for c in names for i in (1, 2, 3, 5)}
