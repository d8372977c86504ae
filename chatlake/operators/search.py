"""Full-text search: all terms, placeholders excluded, newest first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions.scalars import fold_ascii

GRAM = 3
#: Numbers repeat across shards and chats, so a message is known by all three.
KEY = ("chat", "db", "local_id")


def has_term(text: Column, term: str) -> Column:
    """Terms of three characters and more ignore case of any script, shorter ones that of ASCII letters."""
    if len(term) >= GRAM:
        return F.contains(F.lower(text), F.lit(term.lower()))
    return F.contains(fold_ascii(text), fold_ascii(F.lit(term)))


def search(messages: DataFrame, terms: Sequence[str], exclude_kinds: Sequence[str] = (), sender: str | None = None, limit: int | None = None) -> DataFrame:
    """Messages that have every term; a sender is matched as a part of its name, ASCII case ignored."""
    hit = messages
    for t in terms:
        hit = hit.filter(has_term(F.col("text"), t))
    if exclude_kinds:
        hit = hit.filter(~F.col("kind").isin(*exclude_kinds))
    if sender is not None:
        hit = hit.filter(has_term(fold_ascii(F.col("sender")), sender[: GRAM - 1]) & F.contains(fold_ascii(F.col("sender")), fold_ascii(F.lit(sender))))
    if limit is None:
        return hit
    return hit.orderBy(F.col("ts").desc(), F.col("dbr").desc(), F.col("local_id").desc(), "chat").limit(limit)


def trigram_postings(messages: DataFrame) -> DataFrame:
    """(gram, chat, db, local_id): every distinct three characters of every lower-cased text."""
    rows = messages.filter(F.length("text") >= GRAM).select(*KEY, F.split(F.lower("text"), "").alias("_c"))
    at = F.sequence(F.lit(1), F.size("_c") - (GRAM - 1))
    grams = F.transform(at, lambda i: F.concat(*[F.element_at("_c", i + k) for k in range(GRAM)]))
    return rows.select(*KEY, F.explode(F.array_distinct(F.when(F.size("_c") >= GRAM, grams))).alias("gram"))


BUCKETS = 256


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_postings(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the posting table in BUCKETS folders by gram, sorted within each, so that a search reads the folders and row groups of its grams; ``append`` adds new messages."""
    rows = trigram_postings(messages).withColumn("bucket", _bucket(F.col("gram")))
    rows.repartition("bucket", F.pmod(F.xxhash64("chat"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(path)


def read_postings(spark, path: str, terms: Sequence[str], shards: bool = False) -> DataFrame:
    """The stored postings (chat, local_id, gram) of the terms' grams, with ``shards`` db too; other folders aren't listed."""
    key = KEY if shards else ("chat", "local_id")
    grams = sorted({t.lower()[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if not grams:
        return spark.read.parquet(path).select(*key, "gram").limit(0)
    wanted = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]  # one row a gram of the request
    return spark.read.parquet(path).filter(F.col("bucket").isin(*wanted) & F.col("gram").isin(*grams)).select(*key, "gram")


def trigram_search(messages: DataFrame, postings: DataFrame, terms: Sequence[str], exclude_kinds: Sequence[str] = ()) -> DataFrame:
    """The same rows as ``search``: candidates have every gram of the terms, and are then verified."""
    grams = sorted({t.lower()[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if not grams:
        return search(messages, terms, exclude_kinds)
    # Postings that an append repeated count once; without db, what shares a number is looked at together, and verified alone.
    key = [k for k in KEY if k in postings.columns]
    keys = postings.filter(F.col("gram").isin(*grams)).groupBy(*key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return search(messages.join(keys, key, "left_semi"), terms, exclude_kinds)


def grouped(hits: DataFrame) -> DataFrame:
    """(chat, n, ids): hits of each chat, newest first."""
    newest = F.array_sort(F.collect_list(F.struct((-F.col("ts")).alias("o"), (-F.col("local_id")).alias("p"))))
    return hits.groupBy("chat").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(newest, lambda x: (-x["p"]).cast("string")), ",").alias("ids"))
