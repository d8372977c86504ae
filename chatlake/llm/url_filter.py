"""URL filter: a blocked Bloom filter of listed URL prefixes, then an exact join.

Main path is DataFrame functions only. Each URL yields its candidate keys, the
suffixes of its host with as many labels as a listed host has, with every listed length of its path; the Bloom filter keeps
the few that may be listed; an exact equi-join removes its false positives.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
matches nothing; an empty list leaves every page with ``default``; of a rule listed with
two verdicts the greater text stands (block before allow); equal pages are judged alike, each on its own; the input's other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter is one array of 64-bit blocks that each task holds: at most 512 KB.
MAX_BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path without query and fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of one 64-bit block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row with ``bits``, the filter's blocks as an array<bigint>."""
    own = keys.groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_mask(F.col(column))).alias("mask"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    full = every.join(own, "block", "left").select("block", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "mask"))), lambda x: x["mask"]).alias("bits"))


def blocks_for(n_listed: int) -> int:
    """About 16 bits a key, as a power of two, at most MAX_BLOCKS; more keys only let more false positives through to the join."""
    return min(MAX_BLOCKS, 1 << max(4, (n_listed // 4).bit_length()))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path;
    the longest fitting rule wins. No rule: rule null, verdict ``default``.
    """
    host, path = host_and_path(F.col(url_col))
    listed = rules.select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("path").alias("n_path"), F.size(F.split("host", r"\.")).alias("n_labels")
    ).groupBy("rule").agg(F.max("rule_verdict").alias("rule_verdict"), F.collect_set("n_path").alias("n_path"), F.collect_set("n_labels").alias("n_labels"))
    blocks = blocks_for(listed.count())
    # As many numbers as there are different lengths, and counts of labels, of listed paths and hosts.
    lengths = listed.select(F.explode("n_path").alias("n")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    labels = listed.select(F.explode("n_labels").alias("n")).agg(F.sort_array(F.collect_set("n")).alias("labels"))
    parts = F.split("host", r"\.")
    within = F.filter(F.col("_labels"), lambda n: n <= F.size("_parts"))
    suffixes = F.transform(within, lambda n: F.array_join(F.slice("_parts", F.size("_parts") - n + 1, n), "."))
    fits = F.filter(F.col("_lengths"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    bits = F.col("_bits")
    maybe = F.filter(F.col("_keys"), lambda k: F.element_at(bits, _block(k, blocks) + 1).bitwiseAND(_mask(k)) == _mask(k))
    judged = (
        pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
        .withColumns({"_lengths": lengths.scalar(), "_labels": labels.scalar(), "_bits": bloom(listed, "rule", blocks).scalar(), "_parts": parts})
        .withColumn("_keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys))
        .withColumn("_maybe", maybe)
        .drop("_lengths", "_labels", "_bits", "_keys", "_parts")
    )
    hits = (
        judged.filter(F.size("_maybe") > 0)
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_row", id_col, "host", "path", F.explode("_maybe").alias("rule"))
        .join(listed.select("rule", "rule_verdict", F.length("rule").alias("n_rule")), "rule", "left")
        .groupBy("_row", id_col, "host", "path")
        .agg(F.max(F.when(F.col("n_rule").isNotNull(), F.struct("n_rule", "rule", "rule_verdict"))).alias("best"))
        .select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )
    clear = judged.filter(F.size("_maybe") == 0).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return hits.unionByName(clear)


#: The rules of the registered query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
