"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, as in tests, a new local one, and on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-chatlake-", dir="/tmp"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    The table outlives any executor. It stays until ``drop_stored`` or the end of its ``scope``, because the
    frame that reads it is lazy and may be used long after this call.
    """
    path = f"{shared_dir(df.sparkSession)}/chatlake-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored inside once it is left: write what is made of them before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored``, but kept whatever scope it is in."""
    _scopes.append([])
    try:
        return stored(df, name)
    finally:
        _scopes.pop()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until no column is called so, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def drop_stored(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/chatlake-{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which grows with the deployment's data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
