"""A key-value cache as stream state: writes replace, reads give what is held, or zeros; both may come in one stream."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..ship import ship

#: What a row of the stream asks for.
READ, WRITE = "read", "write"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextlib.contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings of queries that are started within the block: state in RocksDB, as processors need it."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Cache(StatefulProcessor):
    """One key: its value, when it was written, and a timer after which it is forgotten."""

    def __init__(self, key: str, dim: int, keep_ms: int | None):
        self.key, self.dim, self.keep_ms = key, dim, keep_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "value array<double>, seq long, timer long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The state before the stream's first row: the last row of the table for this key."""
        held = self._held.get()
        if held is None or initialState.seq >= held[1]:
            self._held.update((list(initialState.value), initialState.seq, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held.get()
        value, seq, timer = (list(held[0]), held[1], held[2]) if held is not None else (None, None, 0)
        wrote = False
        for r in sorted(rows, key=lambda r: (r.seq, r.kind == READ)):  # one key's rows of one micro-batch
            if r.kind == WRITE:
                if seq is None or r.seq >= seq:  # a write that comes late doesn't replace a later one
                    value, seq, wrote = list(r.value), r.seq, True
            else:
                yield Row(**{self.key: key[0]}, seq=r.seq, value=value if value is not None else [0.0] * self.dim, found=value is not None)
        if wrote:
            if self.keep_ms is not None:
                if timer:
                    self._handle.deleteTimer(timer)
                timer = timerValues.getCurrentWatermarkInMs() + self.keep_ms
                self._handle.registerTimer(timer)
            self._held.update((value, seq, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._held.clear()
        yield from ()

    def close(self) -> None:
        pass


def cache(events: DataFrame, key: str, dim: int, initial: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """(key, seq, value, found) for every read of a stream of events (key, kind, seq, value array<double>).

    A key's rows of one micro-batch are taken in the order of seq, a write before a read of the same number. A key that holds
    nothing reads as dim zeros. initial (key, seq, value): what the cache holds at the start. keep_ms: a value is forgotten
    when the watermark has gone on by so much since it was written; events need a watermark on `at` then.
    """
    ship(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, seq long, value array<double>, found boolean"
    start = initial.select(key, "seq", "value").groupBy(key) if initial is not None else None
    columns = [key, "kind", "seq", "value", *(["at"] if keep_ms is not None else [])]
    return events.select(*columns).groupBy(key).transformWithState(Cache(key, dim, keep_ms), schema, "append", "none" if keep_ms is None else "eventTime", initialState=start)


def cached_reads(events: DataFrame, key: str, dim: int, initial: DataFrame | None = None) -> DataFrame:
    """The same over a table: each read by the last write before it."""
    from pyspark.sql import Window as W

    rows = events.select(key, "kind", "seq", "value")
    if initial is not None:
        rows = initial.select(key, F.lit(WRITE).alias("kind"), F.lit(None).cast("long").alias("seq"), "value").unionByName(rows)
    order = W.partitionBy(key).orderBy(F.col("seq").asc_nulls_first(), F.col("kind") == READ).rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(F.col("kind") == WRITE, F.col("value")), True).over(order)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return rows.withColumn("_held", held).where(F.col("kind") == READ).select(key, "seq", F.coalesce("_held", zeros).alias("value"), F.col("_held").isNotNull().alias("found"))
