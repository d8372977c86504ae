"""Which share of the removed windows the engines of op1 and op8 find, the rest being those of hot keys: ``python -m tests.llm.shares sf0.1 check_s``."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.passages import repeated_spans
from chatlake.llm.scratch import scope
from chatlake.llm.substring_dedup import automaton_engine
from chatlake.llm.suffix_dedup import suffix_engine


def nothing(lengths, owners, keys, words, hashes):
    none = np.zeros(0, np.int64)
    return none, none, none, none


def windows(spans: DataFrame) -> int:
    """How many windows some spans have, each counted once."""
    each = spans.select("doc_id", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("windows") - 1)).alias("at"))
    return each.distinct().count()


def measure(docs: DataFrame) -> dict[str, tuple[int, float]]:
    """(windows removed, share that only the engine finds) by engine."""
    out = {}
    with scope(docs.sparkSession):
        rest = windows(repeated_spans(docs, nothing))
        for name, engine in (("automata", automaton_engine()), ("arrays", suffix_engine())):
            every = windows(repeated_spans(docs, engine))
            out[name] = every, (every - rest) / max(every, 1)
    return out


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for table in sys.argv[1:]:
        for name, found in measure(session.read.parquet(f"/root/testdata/{table}/documents.parquet")).items():
            print(table, name, "windows %d, by the engine %.4f" % found, flush=True)
