"""Keyed state with timers and expiry, on the RocksDB state store.

What depends on the row before of the same key is decided in order of event time: rows wait in list state until the watermark has
passed them, a timer wakes the bucket that the key is in, and its rows are taken in order, whatever batches they came in. A value
state holds the few numbers that each key's next row needs; a key's go when it has been silent for too long. So state is bounded by the keys that are
alive and by the rows within the watermark's delay; it lives in the store, not in a worker.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt to so many buckets, each of which is a group of a stream; and rows that are given out at once.
BUCKETS = 2048
MOST_ROWS = 10000
WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("has_id", pa.bool_()), ("event_id", pa.int64()), ("marker", pa.bool_())])
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]


@contextlib.contextmanager
def rocksdb(spark: SparkSession, idle_batches: bool = True):
    """Streams that are started meanwhile keep their state in RocksDB; the session's settings are put back after.

    Without idle_batches a job does not go on for the sake of timers alone, which one on the clock's time would for ever.
    """
    wanted = {_PROVIDER: _ROCKSDB, _IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class InOrder(StatefulProcessor):
    """Takes the rows (key, at, has_id, event_id, marker) of each key of a bucket in order and calls step(kept, (at, event_id, marker)) -> (kept, result or none).

    kept starts with the microseconds of the row that it is from. A row that comes more than `keep` microseconds later finds none.
    Rows wait as packed tables, one a batch, and what is kept of a bucket's keys is one too: a call to the store costs as much as
    many rows do, so calls go by buckets and not by keys.
    """

    def __init__(self, step: Step, kept: list[str], result: list[str], keep: int | None):
        self.step, self.fields, self.result, self.keep = step, kept, result, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.kept = handle.getValueState("kept", "packed binary")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            self.waiting.appendValue((packed(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False)),))
            most = int(part["at"].max())
            last = most if last is None else max(last, most)
        self._wake(last)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.concat_tables([WAITING.empty_table(), *(unpacked(x[0]) for x in self.waiting.get())])
        ready = rows.filter(pc.less(rows["at"], passed))
        if not len(ready) and self.keep is None:
            return
        ready = ready.sort_by([("key", "ascending"), ("at", "ascending"), ("has_id", "descending"), ("event_id", "ascending")])
        before = self.kept.get()
        kept = {} if before is None else {k: tuple(v) for k, *v in zip(*(c.to_pylist() for c in unpacked(before[0]).columns), strict=True)}
        out = []
        for k, at, has_id, event_id, marker in zip(*(c.to_pylist() for c in ready.columns), strict=True):
            known = kept.get(k)
            kept[k], result = self.step(None if known and self.keep is not None and at - known[0] > self.keep else known, (at, event_id if has_id else None, marker))
            if result is not None:
                out.append((k, *result))
            if len(out) == MOST_ROWS:
                yield self._table(out)
                out = []
        if len(ready):
            rest = rows.filter(pc.greater_equal(rows["at"], passed))
            self.waiting.put([(packed(rest),)]) if len(rest) else self.waiting.clear()
        if self.keep is not None:
            kept = {k: v for k, v in kept.items() if v[0] + self.keep >= passed}
        if kept:
            self.kept.update((packed(pa.table([pa.array(list(kept), pa.string()), *(pa.array(v, pa.int64()) for v in zip(*kept.values(), strict=True))], ["key", *self.fields])),))
            if self.keep is not None and len(ready):
                self._wake(max(v[0] for v in kept.values()) + self.keep)
        elif before is not None:
            self.kept.clear()
        if out:
            yield self._table(out)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        key, *values = zip(*rows, strict=True)
        return pd.DataFrame({"key": key} | {n: pd.array(v, "Int64") for n, v in zip(self.result, values, strict=True)})


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def micros(interval: str | None) -> int | None:
    """Microseconds of an interval such as '2 hours'."""
    return None if interval is None else int(pd.Timedelta(interval).value // 1000)


def in_order(events: DataFrame, key: str, time: str, step: Step, kept: str, result: str, late: str, keep: str | None, id_col: str = "event_id", marker: Column | None = None) -> DataFrame:
    """A stream (key, *result) of what step gives for the rows of each key, in order of time and id.

    late is how long rows may come after newer ones; later ones are lost, and so are rows without a time. A null key is a key of its own.
    kept and result are numbers (long).
    """
    x = events.where(F.col(time).isNotNull()).withWatermark(time, late).withColumn("_key", F.col(key).cast("string"))
    found = F.col(id_col).cast("long")
    x = x.select(F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).alias("bucket"), F.col("_key").alias("key"), F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), found.isNotNull().alias("has_id"), F.coalesce(found, F.lit(0)).alias("event_id"), F.coalesce(F.lit(False) if marker is None else marker, F.lit(False)).alias("marker"))
    names = lambda fields: [c.split()[0] for c in fields.split(", ")]
    return x.groupBy("bucket").transformWithStateInPandas(InOrder(step, names(kept), names(result), micros(keep)), f"key string, {result}", "Append", "EventTime")


class Returned(StatefulProcessor):
    """Gives a key's first row, and again the first one after a silence of ttl milliseconds; the store drops silent keys itself."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = None, 0
        for part in rows:
            least, most = int(part["at"].min()), int(part["at"].max())
            first, last = least if first is None else min(first, least), max(last, most)
        known = self.seen.exists()
        self.seen.update((last,))
        if not known:
            yield pd.DataFrame({"key": [key[0]], "at": [first]})


def returned(events: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """A stream (key, first_time): keys that appear for the first time, or again when no row came for ttl (by the clock of the job)."""
    x = events.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    out = x.groupBy("key").transformWithStateInPandas(Returned(micros(ttl) // 1000), "key string, at long", "Append", "ProcessingTime")
    return out.select("key", F.timestamp_micros("at").alias("first_time"))
