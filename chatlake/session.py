"""Session settings that every job of the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "chatlake", cpus: int | None = None) -> SparkSession:
    """A session for local work; on a cluster the submit command's settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", str(cpus))
        )
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which a cluster must name; in a local session without it, one under /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-chatlake-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
