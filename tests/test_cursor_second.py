"""Pages before a time, with messages of both shards in the cursor's very second."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chatlake import registry
from chatlake.plans.message_queries import CURSOR


@pytest.mark.parametrize("query", ["page_backward", "page_forward", "page_has_more"])
def test_messages_in_the_second_of_the_cursor(spark, tmp_path, query):
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"), F.timestamp_seconds(CURSOR + F.floor((F.col("id") - 30) / 4)).cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[query]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
