"""Freshness by Structured Streaming: landed messages to a deduplicated table and export tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("chat", "db", "local_id")


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over immutable landing snapshots in Parquet."""
    return spark.readStream.schema(schema).parquet(path)


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of their content; an edited or recalled row has another one."""
    return rows.withColumn("content_hash", F.xxhash64("kind", "text"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last landed state of every message; ``snapshots`` has a column landed_at."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("landed_at").desc(), F.col("content_hash")))
    return snapshots.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def export_tail(stream: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Append each batch's new rows under ``out``, partitioned by batch, so that a batch run again replaces itself.

    Beside the table is its tail state, one folder a batch: of each chat the rows at its last time. A batch reads the
    state before it, never the history, so its cost is that of its rows and of the chats. A row is late only for its own
    chat, as in ``incremental.select_new``: no row is too old for a chat without state, so ``late`` bounds nothing any
    more; callers may still give it.
    """
    spark, same = stream.sparkSession, [*KEY, "content_hash"]
    state_path = out.rstrip("/") + "-state"

    def write(batch: DataFrame, batch_id: int) -> None:
        held = _state_before(spark, state_path, batch_id)
        rows = hashed(batch).dropDuplicates(same)
        if held is not None:
            ends = held.groupBy("chat").agg(F.max("ts").alias("last_ts"))
            placed = rows.join(ends, "chat", "left")
            later = placed.filter(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).select(*rows.columns)
            tied = placed.filter(F.col("ts") == F.col("last_ts")).select(*rows.columns).join(held.select(*KEY), list(KEY), "left_anti")
            rows = later.join(held.select(*same), same, "left_anti").unionByName(tied)
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = hashed(spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}")).select(*same, "ts")
        after = written if held is None else written.unionByName(held)
        last = after.groupBy("chat").agg(F.max("ts").alias("ts"))
        after.join(last, ["chat", "ts"], "left_semi").write.mode("overwrite").parquet(f"{state_path}/{batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state that the last batch before ``batch_id`` left, or null."""
    if not _exists(spark, path):
        return None
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder))
    before = [n for n in names if n.isdigit() and int(n) < batch_id]
    return spark.read.parquet(f"{path}/{before[-1]}") if before else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
