"""Messages, people and rooms as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import table


def seconds(column) -> F.Column:
    """Unix seconds of a timestamp without time zone, read as UTC."""
    return F.unix_seconds(F.col(column).cast("timestamp")) if isinstance(column, str) else F.unix_seconds(column.cast("timestamp"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each event: the user is the chat, the event type the kind; events alternate between two shards, in which their numbers repeat."""
    e = table(spark, sf_dir, "events")
    db = F.pmod("event_id", F.lit(2)).cast("int")
    return e.select(
        F.col("user_id").alias("chat"), db.alias("db"), (-db).alias("dbr"), F.floor(F.col("event_id") / 2).cast("long").alias("local_id"), seconds("ts").alias("ts"), (F.col("event_id") * 10).alias("server_id"),
        F.col("event_type").alias("kind"), "value", F.col("props").alias("extra"),
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each turn: the role is the sender, a user's turn is one's own."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("chat"), F.lit(0).alias("db"), F.lit(0).alias("dbr"), F.col("turn").alias("local_id"), F.col("turn").alias("ts"),
        F.col("role").alias("sender"), (F.col("role") == "user").alias("is_self"), F.when(F.col("role") == "system", "system").otherwise("text").alias("kind"), "text",
    )


def contact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contacts, and suppliers as strangers that share keys with some of them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("contact").alias("source"), F.col("c_name").alias("nick_name"), F.col("c_mktsegment").alias("remark"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("stranger").alias("source"), F.col("s_name").alias("nick_name"), F.lit("").alias("remark"))
    return c.unionByName(s)


def room_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rooms; the suppliers of their lines are the members, in line order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("room"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("member"))
