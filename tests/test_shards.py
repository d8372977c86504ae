"""The shard reader's pushed filters and its stream, on SQLite files."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from chatlake.sources import shards

COLUMNS = "local_id INTEGER PRIMARY KEY, server_id INTEGER, local_type INTEGER, sort_seq INTEGER, real_sender_id INTEGER, create_time INTEGER, message_content, WCDB_CT_message_content INTEGER"


def add(path, table, rows):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({COLUMNS})")
        db.executemany(f"INSERT INTO {table} (local_id, local_type, create_time, message_content) VALUES (?, ?, ?, ?)", rows)
    db.close()


@pytest.fixture
def archive(tmp_path):
    for number in (0, 2, 10):
        add(tmp_path / f"message_{number}.db", "Msg_a", [(1, 1, 100 + number, "hi"), (2, 47, 200, b"\x01"), (3, (57 << 32) | 49, 300, "x"), (4, None, None, None), (5, "odd", 500, "text for a type")])
        add(tmp_path / f"message_{number}.db", "Msg_b", [(1, 47, 150, "s")])
    return tmp_path


def rows(df):
    return sorted(tuple(r) for r in df.select("db", "dbr", "tbl", "local_id", "local_type", "base_type", "create_time", F.decode("content", "UTF-8")).collect())


FILTERS = [
    "tbl = 'Msg_b'", "tbl in ('Msg_a', 'Msg_zz')", "db = 2", "db in (0, 10) and tbl = 'Msg_a'", "base_type = 49", "base_type in (47, 49) and create_time > 150", "create_time is null", "local_type is not null", "local_id >= 2 and local_id < 4",
    "create_time <= 200 and server_id is null", "db = 99", "local_type <=> null", "local_type = 47 or local_id = 1", "substr(tbl, 5) = 'b'",
]


@pytest.mark.parametrize("condition", FILTERS)
def test_pushed_filters_give_the_same_rows(spark, archive, condition):
    plain = spark.read.format("message_shards").load(str(archive)) if spark.dataSource.register(shards.MessageShards) is None else None
    want = rows(spark.createDataFrame(plain.collect(), plain.schema).filter(condition))
    assert rows(shards.read_shards(spark, str(archive)).filter(condition)) == want


def test_plan_shows_pushed_filters_and_other_tables_stay_closed(spark, archive, capsys):
    found = shards.read_shards(spark, str(archive)).filter("tbl = 'Msg_b' and base_type = 47 and create_time > 100 and length(content) > 0")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(tbl,Msg_b), EqualTo(base_type,47), GreaterThan(create_time,100)]" in plan
    (condition,) = [line for line in plan.splitlines() if line.startswith("Condition")]
    assert "base_type" not in condition and "tbl" not in condition  # Spark has nothing left to do there
    reader = shards._PushingReader(str(archive))
    assert list(reader.pushFilters([shards.EqualTo(("tbl",), "Msg_b"), shards.In(("db",), (2, 10))])) == []
    assert [(p.number, p.table) for p in reader.partitions()] == [(2, "Msg_b"), (10, "Msg_b")]
    (archive / "message_0.db").write_bytes(b"no database")  # not opened, so not missed
    assert len(list(reader.read(reader.partitions()[0]))) == 1


def test_shards_in_numeric_order_with_typed_rows(spark, archive):
    assert [n for n, _ in shards.shard_files(str(archive))] == [0, 2, 10]
    got = {(r.db, r.local_id): r for r in shards.read_shards(spark, str(archive)).filter("tbl = 'Msg_a'").collect()}
    assert got[10, 3].base_type == 49 and got[10, 3].dbr == -10 and got[10, 3].local_type == (57 << 32) | 49
    assert got[2, 5].local_type is None and got[2, 5].base_type is None and bytes(got[2, 2].content) == b"\x01" and got[0, 4].content is None


def poll(spark, archive, out, checkpoint):
    stream = shards.stream_shards(spark, str(archive))
    shards.every(stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)), 0).start().awaitTermination()
    return spark.read.parquet(str(out))


def test_stream_gives_each_row_once_and_reports_changes(spark, archive, tmp_path_factory):
    out, checkpoint = tmp_path_factory.mktemp("out") / "rows", tmp_path_factory.mktemp("checkpoint")
    key = lambda df: sorted((r.db, r.tbl, r.local_id, r.rebuilt) for r in df.collect())
    first = key(poll(spark, archive, out, checkpoint))
    assert len(first) == len(set(first)) == 18 and not any(k[3] for k in first)
    add(archive / "message_10.db", "Msg_a", [(6, 1, 600, "new"), (9, 1, 900, "newer")])
    add(archive / "message_11.db", "Msg_c", [(1, 1, 50, "another shard")])
    second = key(poll(spark, archive, out, checkpoint))
    assert second == sorted([*first, (10, "Msg_a", 6, False), (10, "Msg_a", 9, False), (11, "Msg_c", 1, False)])
    assert key(poll(spark, archive, out, checkpoint)) == second  # nothing landed, nothing comes
    with sqlite3.connect(archive / "message_2.db") as db:
        db.execute("UPDATE Msg_a SET local_type = 10000 WHERE local_id = 1")
    db.close()
    third = key(poll(spark, archive, out, checkpoint))
    assert [k for k in third if k[3]] == [(2, "Msg_a", i, True) for i in range(1, 6)] and len(third) == len(second) + 5


def test_a_poll_reads_only_what_is_above_the_offset(archive):
    reader = shards._StreamReader(str(archive))
    start = reader.latestOffset()
    assert reader.partitions(start, start) == []
    add(archive / "message_0.db", "Msg_b", [(7, 1, 1, "y")])
    os.utime(archive / "message_0.db", ns=(1, 1))
    end = reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert (part.number, part.table, part.after, part.upto, part.rebuilt) == (0, "Msg_b", 1, 7, False)
    assert [b.column("local_id").to_pylist() for b in reader.read(part)] == [[7]]
    assert reader.known["message_2.db"] is end["files"]["message_2.db"] and shards._StreamReader(str(archive)).latestOffset() == end
