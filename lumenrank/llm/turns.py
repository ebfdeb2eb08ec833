"""Operator 11: conversations put together from turns that arrive in batches, late, repeated and out of order.

Of a batch only the smallest payload `role|text` of a turn (by UTF-8 bytes, then by role) arrives: a minimum that is taken
before the shuffle, when the batch is written. One transformWithState operator, the sequencer, keyed by conv_id, does the rest: it
keeps the first payload that ever arrives of a turn; releases the gapless run of kept turns from the conversation's first, each
once; closes a conversation when PATIENCE batches in a row bring nothing for it; rejects whatever arrives afterwards. Which turns
are kept needs no state of its own: those from the first to the next that is due, and those that wait.

Batches are the clock. Batch b has the event time clock(b), and one row without a turn (a tick) ends each batch, so that time
goes on where nothing arrives. Timers are event-time timers: the sequencer sets one for clock(last arrival + PATIENCE).
A micro-batch runs under the watermark of the batch before it, so a close is written with the batch that follows, and
carries the number of the batch that it belongs to; an arrival that meets a conversation whose time is over closes it first.
Where the number of batches is known, all timers come in the last one at the latest, and what is open is closed behind its rows.

State: for each conversation one row, with up to INLINE waiting turns in it.
Further ones go to a map by turn, with bitmaps of which turns wait, so a conversation of any length is handled turn by turn
and never gathered. State is in RocksDB with a changelog under the query's checkpoint; a lost executor or a stopped query
goes on from there.

Defined results: turns that are null are dropped; role and text that are null count as empty; rows without a conv_id are a
conversation of their own, without an id; an empty table gives no events; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import json
import sys
from collections.abc import Iterator
from hashlib import sha256

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import prepare, shared_path

#: Batches that a table is cut into, and batches in a row without arrivals that close a conversation.
BATCHES, PATIENCE = 12, 3
#: Waiting turns (and characters of them) that stand in a conversation's own row; turns of one bitmap, and bitmaps held at once.
INLINE, INLINE_CHARS, BITMAP, READ = 24, 1 << 16, 4096, 4096
#: Milliseconds between the event times of two batches.
STEP = 60_000

ARRIVAL = "conv_id long, turn long, batch long, role string, text string, first long, at timestamp"
EVENT = "event string, conv_id long, turn long, batch long, role string, text string, n_missing long, n_breaks long, left_sha256 string"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves 4 MB of disk
    # A query that starts anew for each batch never meets its stores again: a task closes its store when it ends, so an executor
    # holds as many as it runs tasks, not one for each partition and operator of this run and those just before.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each write reads first, to count
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # what a failed task has left is closed then
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def clock(batch: int) -> int:
    """Event time of a batch in milliseconds; never 0, which is the first watermark."""
    return (batch + 1) * STEP


class Waiting:
    """Kept turns of one conversation that can't be released yet: in the conversation's row while they are few, else in a map."""

    def __init__(self, inline: list, spilled: bool, turns, bitmaps):
        self.few = {t: (role, text) for t, role, text in inline}
        self.spilled, self._turns, self._bitmaps = spilled, turns, bitmaps
        self._marked: dict[int, bytearray] = {}  # bitmaps read, at most READ

    def _bits(self, block: int) -> bytearray:
        if block not in self._marked:
            if len(self._marked) >= READ:  # all are written where they change
                self._marked.clear()
            old = self._bitmaps.getValue((block,))
            self._marked[block] = bytearray(old[0]) if old else bytearray(BITMAP // 8)
        return self._marked[block]

    def has(self, turn: int) -> bool:
        """For turns that weren't taken; a bitmap keeps those that were."""
        if turn in self.few or not self.spilled:
            return turn in self.few
        at = turn % BITMAP
        return bool(self._bits(turn // BITMAP)[at >> 3] >> (at & 7) & 1)

    def put(self, turn: int, role: str, text: str) -> None:
        self.few[turn] = (role, text)
        if len(self.few) > INLINE or sum(len(a) + len(b) for a, b in self.few.values()) > INLINE_CHARS:
            self._spill()

    def _spill(self) -> None:
        self.spilled = True
        marked: dict[int, list[int]] = {}
        for t, x in self.few.items():
            self._turns.updateValue((t,), x)
            marked.setdefault(t // BITMAP, []).append(t % BITMAP)
        for block, bits in marked.items():
            new = self._bits(block)
            for bit in bits:
                new[bit >> 3] |= 1 << (bit & 7)
            self._bitmaps.updateValue((block,), (bytes(new),))
        self.few = {}

    def take(self, turn: int) -> tuple[str, str] | None:
        got = self.few.pop(turn, None)
        if got is None and self.spilled:
            got = self._turns.getValue((turn,))
            if got is not None:
                self._turns.removeKey((turn,))
                got = tuple(got)
        return got

    def ascending(self) -> Iterator[tuple[int, str]]:
        """Turn and role of all that is left, by turn."""
        if not self.spilled:
            yield from ((t, self.few[t][0]) for t in sorted(self.few))
            return
        self._spill()
        for block in sorted(k[0] for k in self._bitmaps.keys()):
            bits = self._bits(block)
            for at in range(BITMAP):
                if bits[at >> 3] >> (at & 7) & 1 and (got := self._turns.getValue((block * BITMAP + at,))) is not None:
                    yield block * BITMAP + at, got[0]

    def clear(self) -> None:
        self.few = {}
        if self.spilled:
            self._turns.clear()
            self._bitmaps.clear()
            self._marked = {}


class Sequencer(StatefulProcessor):
    """Releases, closes and rejects. end: the number of the batch after the last, in which all is closed that is open then."""

    def __init__(self, end: int | None, patience: int):
        self.end, self.patience = end, patience

    def init(self, handle) -> None:
        self._handle = handle
        self._head = handle.getValueState("head", "packed binary")  # JSON: one column is read and written faster than many
        self._turns = handle.getMapState("turns", "turn long", "role string, text string")
        self._bitmaps = handle.getMapState("bitmaps", "block long", "bits binary")

    def _load(self) -> tuple[dict, Waiting] | None:
        got = self._head.get()
        if got is None:
            return None
        h = json.loads(got[0])
        return h, Waiting(h.pop("inline"), h["spilled"], self._turns, self._bitmaps)

    def _save(self, h: dict, waiting: Waiting | None) -> None:
        h["spilled"] = bool(waiting and waiting.spilled)
        inline = [[t, *x] for t, x in waiting.few.items()] if waiting else []
        self._head.update((json.dumps(h | {"inline": inline}).encode(),))

    def _wait(self, h: dict) -> None:
        """One timer for each conversation: if it comes too early, it is set again. None comes later than in the last batch."""
        h["timer"] = clock(h["last"] + self.patience)
        if self.end is not None:
            h["timer"] = min(h["timer"], clock(self.end - 2) - 1)
        self._handle.registerTimer(h["timer"])

    def _closed(self, conv: int | None, h: dict, waiting: Waiting) -> Row:
        digest, before, breaks = sha256(), None, h["breaks"]
        for turn, role in waiting.ascending():
            digest.update(b"%d" % turn if before is None else b",%d" % turn)
            breaks += before == (turn - 1, role)
            before = turn, role
        waiting.clear()
        h["closed"] = True
        batch = h["last"] + self.patience
        missing = h["largest"] - h["first"] + 1 - h["kept"]
        return Row(
            event="close", conv_id=conv, turn=-1, batch=batch if self.end is None else min(batch, self.end), role=None, text=None,
            n_missing=missing, n_breaks=breaks, left_sha256=digest.hexdigest(),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        conv, found, batch = key[0], None, None
        for r in rows:
            if r.turn is None:  # a tick
                continue
            if found is None:
                found = self._load()
                if found is None:
                    h = {"first": r.first, "next": r.first, "last_role": None, "last": r.batch, "timer": 0, "closed": False, "kept": 0, "largest": r.first, "breaks": 0, "spilled": False}
                    found = h, Waiting([], False, self._turns, self._bitmaps)
                h, waiting = found
                batch = r.batch
                if not h["closed"] and batch - h["last"] > self.patience:
                    self._handle.deleteTimer(h["timer"])
                    yield self._closed(conv, h, waiting)
                h["last"] = batch
            if h["closed"]:
                yield Row(event="reject", conv_id=conv, turn=r.turn, batch=batch, role=r.role, text=r.text, n_missing=None, n_breaks=None, left_sha256=None)
            elif not (h["first"] <= r.turn < h["next"] or waiting.has(r.turn)):
                h["kept"], h["largest"] = h["kept"] + 1, max(h["largest"], r.turn)
                got = (r.role, r.text)
                if r.turn != h["next"]:
                    waiting.put(r.turn, *got)
                    continue
                while got is not None:
                    h["breaks"] += got[0] == h["last_role"]
                    yield Row(event="release", conv_id=conv, turn=h["next"], batch=batch, role=got[0], text=got[1], n_missing=None, n_breaks=None, left_sha256=None)
                    h["last_role"], h["next"] = got[0], h["next"] + 1
                    got = waiting.take(h["next"])
        if found is None:
            return
        if h["closed"]:
            self._save(h, None)
            return
        if not h["timer"]:
            self._wait(h)
        self._save(h, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self._load()
        if found is None or found[0]["closed"]:
            return
        h, waiting = found
        now = timerValues.getCurrentWatermarkInMs()
        ends = self.end is not None and now >= clock(self.end - 2)  # timers of the last batch, whose rows are all handled
        if not ends and clock(h["last"] + self.patience) > now:
            self._wait(h)
            self._save(h, waiting)
            return
        yield self._closed(key[0], h, waiting)
        self._save(h, None)

    def close(self) -> None:
        pass


def reassemble(arrivals: DataFrame, end: int | None = None, patience: int = PATIENCE) -> DataFrame:
    """Events of a stream of arrivals (columns of ARRIVAL; a row without a turn is a tick), one micro-batch for each batch, in which
    a turn has one row at most.

    event: release, reject (both with turn, role and text) or close (turn -1; n_missing: turns never kept between the first and
    the largest kept; n_breaks: kept turns with the role of the kept turn before; left_sha256: of the decimal numbers of the
    kept turns that were not released, ascending, comma-joined). batch: the one the event belongs to, at most end.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own state worker needn't find the package
    timed = arrivals.withWatermark("at", "0 seconds")
    return timed.groupBy("conv_id").transformWithState(Sequencer(end, patience), EVENT, "append", "eventTime")


def smallest(rows: DataFrame, *within: str) -> DataFrame:
    """Of the rows of a turn (and of equal `within`) the one of the smallest payload, as a minimum that is taken before the shuffle."""
    rest = [c for c in ("role", "text", "first") if c in rows.columns]
    payload = F.struct(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("payload"), *rest)
    return rows.groupBy("conv_id", "turn", *within).agg(F.min(payload).alias("p")).select("conv_id", "turn", *within, *[f"p.{c}" for c in rest])


class Feed:
    """A streaming query over batches that are written one after the other, started anew for each on one checkpoint."""

    def __init__(self, spark: SparkSession, end: int | None = None, patience: int = PATIENCE, folder: str | None = None):
        self.spark, self.end, self.patience = prepare(spark), end, patience
        self.folder = folder or shared_path(spark, "turns")

    def push(self, batch: int, rows: DataFrame, last: bool = False, single: bool = False) -> None:
        """Write the arrivals of one batch (ARRIVAL without `at`) with its tick, and run the query over them.

        single: each turn has one row at most, so no smallest payload is looked for. last: end the stream. Batch end - 1 does so by itself; before it, time is put forward by one more micro-batch.
        """
        time = f"timestamp_millis({clock(batch)}L)"
        early = last and (self.end is None or self.end < 2 or batch < self.end - 1)
        tick = clock(max(batch, self.end or 0) + 2 * self.patience if early else batch)
        ticks = self.spark.range(1).selectExpr("null conv_id", "null turn", f"{batch}L batch", "null role", "null text", "null first", f"timestamp_millis({tick}L) at")
        columns = [f.split()[0] for f in ARRIVAL.split(", ")]
        rows = rows if single else smallest(rows.where("turn is not null"), "batch")
        rows.withColumn("at", F.expr(time)).select(*columns).unionByName(ticks).write.mode("append").parquet(f"{self.folder}/in")
        with self._settings({"spark.sql.streaming.noDataMicroBatches.enabled": "true"} if early else {}):
            stream = self.spark.readStream.schema(ARRIVAL).parquet(f"{self.folder}/in")
            # State has a store for each shuffle partition; their events go to as many files as there are cores.
            dealt = reassemble(stream, self.end, self.patience).repartition(self.spark.sparkContext.defaultParallelism)
            events = dealt.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            query = events.option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").start()
        query.awaitTermination()

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.folder}/out")

    @contextlib.contextmanager
    def _settings(self, more: dict[str, str]) -> Iterator[None]:
        """A query takes the session's settings with it when it starts."""
        wanted = _STATE | more
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows of a table of conversations as arrivals in batches, by a hash of conv_id and turn; some come again, with the role user.

    Of a turn only the smallest payload of a batch is left: a minimum that is taken before the shuffle, so a turn with very
    many copies is one row of each task.
    """
    rows = conversations.where("turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("string")), 256)
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    own = F.struct((F.col("h") % batches).alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + 3) % batches).alias("batch"), F.lit("user").alias("role"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("h") % 7 < 2, F.array(own, again)).otherwise(F.array(own))))
    return smallest(rows.select("conv_id", "turn", "to.batch", "to.role", "text"), "batch")


def reassembled(conversations: DataFrame, batches: int = BATCHES, patience: int = PATIENCE) -> DataFrame:
    """All events of a table of conversations that is fed to the stream in batches; the end closes what is open as batch `batches`."""
    spark = prepare(conversations.sparkSession)
    rows = arrivals(conversations, batches)
    first = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("first"))
    path = shared_path(spark, "batches")
    staged = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    staged.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    feed = Feed(spark, batches, patience)
    schema = "conv_id long, turn long, role string, text string, first long, batch long"
    for b in range(batches):
        feed.push(b, spark.read.schema(schema).parquet(path).where(F.col("batch") == b), last=b == batches - 1, single=True)
    return feed.events()
