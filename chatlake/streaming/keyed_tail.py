"""The export tail as keyed state: one small state for each account, chat and format, kept by the stream itself.

    use_rocksdb(spark)
    new = new_rows(with_formats(stream, ["txt", "csv"]), late="drop")
    append(new, "/out", "/checkpoint")

The state of a key is the last exported time and how many rows have it, as in ``incremental.tail_state``, with the places of those
rows. A batch emits the rows after the last time, and at the last time those whose place isn't known yet; the others are late. What
was emitted and the state are committed together by the engine, so a restart neither loses nor repeats a row, and no batch
reads anything but its own rows and its keys' states. Keys are dealt by hash into buckets, whose rows Python handles together, as a call
for each key costs far more than a key's rows; in a bucket's map each key has an entry of its own: a pair of numbers and the places of one
second, however large the chat.

Late rows: ``drop`` leaves them out, as an appended file can't take them; ``upsert`` emits them with ``late`` true, for sinks that
replace by (chat, db, local_id); ``merged`` reads such a sink. An initial state, such as the one read from exported files, lets a stream go
on where those end: of rows at its last time as many as it counts, in order, are taken as exported.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

KEYS = ("account", "chat", "fmt")
PLACE = ("chat", "db", "local_id")
POLICIES = ("drop", "upsert")
#: A row's key as one text, and the bucket of that; Spark makes tuples of the rows, so neither begins with "_". Fixed value: the buckets of a checkpoint must stay what they are.
NAME, BUCKET, BUCKETS = "tail_key", "tail_bucket", 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on the workers' disks with changes in the checkpoint, as keyed state asks."""
    spark.conf.set(PROVIDER, ROCKSDB)


def with_formats(messages: DataFrame, formats: Sequence[str], account: str = "") -> DataFrame:
    """A row for each format; each has its own tail."""
    rows = messages if "account" in messages.columns else messages.withColumn("account", F.lit(account))
    return rows.withColumn("fmt", F.explode(F.array(*map(F.lit, formats))))


@dataclass
class Held:
    """A key's tail as a batch finds it, and the places at the greatest time that the batch has above it."""

    last_ts: int | None = None
    n: int = 0
    unplaced: int = 0  # exported before the stream began, places unknown
    places: set[tuple[int, int]] = field(default_factory=set)
    changed: bool = False
    top_ts: int | None = None
    top: set[tuple[int, int]] = field(default_factory=set)

    def reach(self, ts: int, place: tuple[int, int]) -> None:
        """A row above ``last_ts``."""
        if self.top_ts is None or ts > self.top_ts:
            self.top_ts, self.top = ts, set()
        if ts == self.top_ts:
            self.top.add(place)

    def meet(self, place: tuple[int, int]) -> bool:
        """A row at ``last_ts``; whether it is new."""
        if place in self.places:
            return False
        self.places.add(place)
        self.changed = True
        if self.unplaced:
            self.unplaced -= 1
            return False
        self.n += 1
        return True

    def state(self) -> tuple[int, int, int, str] | None:
        """What is kept; None if that stays as it was."""
        if self.top_ts is not None:
            return self.top_ts, len(self.top), 0, json.dumps(sorted(self.top))
        return (self.last_ts, self.n, self.unplaced, json.dumps(sorted(self.places))) if self.changed else None


class Tail(StatefulProcessor):
    """A bucket's rows with the key, ts, db, dbr and local_id in, the same with ``late`` out."""

    def __init__(self, columns: list[str], late: str) -> None:
        self.columns, self.late = columns, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tails = handle.getMapState("tails", "name string", "last_ts long, n long, unplaced long, places string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, last_ts, n in zip(initialState[NAME], initialState["last_ts"], initialState["n_last"], strict=True):
            self.tails.updateValue((name,), (int(last_ts), int(n), int(n), "[]"))

    def _held(self, name: str) -> Held:
        found = self.tails.getValue((name,))
        return Held() if found is None else Held(found[0], found[1], found[2], set(map(tuple, json.loads(found[3]))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tails: dict[str, Held] = {}
        tied: list[pd.DataFrame] = []
        for part in rows:
            codes, names = pd.factorize(part[NAME])
            for name in names:
                if name not in tails:
                    tails[name] = self._held(name)
            began = [tails[name].last_ts for name in names]
            known = np.array([b is not None for b in began])[codes]
            last, ts = np.array([b or 0 for b in began])[codes], part["ts"].to_numpy()
            at, older, newer = known & (ts == last), known & (ts < last), ~known | (ts > last)
            if at.any():
                tied.append(part[at])
            if self.late == "upsert" and older.any():
                yield self._out(part[older], True)
            if not newer.any():
                continue
            part = part[newer]
            own = part[part["ts"] == part["ts"].groupby(codes[newer]).transform("max")]
            for name, t, place in zip(own[NAME], own["ts"].astype(int).tolist(), self._places(own), strict=True):
                tails[name].reach(t, place)
            yield self._out(part, False)
        if tied:  # rows of one second a key
            at = pd.concat(tied).sort_values([NAME, "dbr", "local_id"], kind="stable").drop_duplicates([NAME, "db", "local_id"])
            fresh = [tails[name].meet(place) for name, place in zip(at[NAME], self._places(at), strict=True)]
            if any(fresh):
                yield self._out(at[fresh], False)
        for name, held in tails.items():
            state = held.state()
            if state is not None:
                self.tails.updateValue((name,), state)

    def _places(self, rows: pd.DataFrame) -> list[tuple[int, int]]:
        return list(zip(rows["db"].astype(int).tolist(), rows["local_id"].astype(int).tolist(), strict=True))

    def _out(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return rows[self.columns].assign(late=late)

    def close(self) -> None:
        """Nothing is held."""


def new_rows(stream: DataFrame, late: str = "drop", initial: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of ``stream`` that each key's export doesn't have yet, with ``late``; ``initial`` has the keys, last_ts and n_last."""
    if late not in POLICIES:
        raise ValueError(f"{late} is none of {', '.join(POLICIES)}")
    schema = StructType([*stream.schema.fields]).add("late", BooleanType())
    state = None
    if initial is not None:
        own = [F.col(k).cast(stream.schema[k].dataType).alias(k) for k in keys]  # as texts, keys are equal only if their types are
        state = _dealt(initial.select(*own, F.col("last_ts").cast("long"), F.col("n_last").cast("long")), keys).groupBy(BUCKET)
    return _dealt(stream, keys).groupBy(BUCKET).transformWithStateInPandas(Tail(stream.columns, late), schema, "Append", "None", state)


def _dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their key's text and bucket."""
    named = rows.withColumn(NAME, F.to_json(F.struct(*keys), {"ignoreNullFields": "true"}))
    return named.withColumn(BUCKET, F.pmod(F.xxhash64(NAME), F.lit(BUCKETS)).cast("int"))


def append(rows: DataFrame, out: str, checkpoint: str, partition: Iterable[str] = ("fmt",)) -> StreamingQuery:
    """Everything that has landed, appended under ``out`` in Parquet by the exactly-once file sink."""
    return rows.writeStream.format("parquet").partitionBy(*partition).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merged(written: DataFrame, order: str = "landed_at") -> DataFrame:
    """One row of each format's (chat, db, local_id), the one landed last: what an upserting sink holds."""
    nth = F.row_number().over(Window.partitionBy("account", "fmt", *PLACE).orderBy(F.col(order).desc()))
    return written.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "late")
