"""Exports that go on where they stopped: numbered batches, each written to a folder of its own and committed by one small file.

A batch counts once its record is in the log. Records are written under a name of their own and renamed without overwriting, so of two
writers one wins; what a lost or killed run left without a record is never read, and is deleted when the next run starts. To
resume, only the log is listed: no keys are read. A record also holds the number and a hash of the keys of its batch, so
that rows that changed meanwhile are noticed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """Committed batches of a table at path: data/<folder> for each, log/<batch>.json for their records."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _list(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def records(self) -> dict[int, dict]:
        """What is committed, by batch."""
        names = [n for n in self._list("log") if n.endswith(".json") and n[:-5].isdigit()]
        if not names:
            return {}
        lines = self.spark.read.text([f"{self.path}/log/{n}" for n in names]).collect()  # a line for each batch
        return {r["batch"]: r for r in (json.loads(x[0]) for x in lines)}

    def discard_tail(self) -> list[str]:
        """Delete folders and records that no committed batch names; which ones they were."""
        kept = {r["folder"] for r in self.records().values()}
        gone = [f"data/{n}" for n in self._list("data") if n not in kept] + [f"log/{n}" for n in self._list("log") if n.endswith(".tmp")]
        for name in gone:
            self._fs.delete(self._at(*name.split("/")), True)
        return gone

    def commit(self, batch: int, frame: DataFrame, **facts) -> bool:
        """Write a frame as this batch and commit it with these facts; False if it was committed before: then nothing is written."""
        if self._fs.exists(self._at("log", f"{batch}.json")):
            return False
        folder = f"{batch}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/data/{folder}")
        temporary = self._at("log", f"{folder}.tmp")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"batch": batch, "folder": folder} | facts).encode()))
        out.close()
        final = self._at("log", f"{batch}.json")
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            self._fs.delete(self._at("data", folder), True)
            return False
        return True

    def read(self) -> DataFrame | None:
        """Rows of all committed batches; None before the first one."""
        found = self.records()
        return self.spark.read.parquet(*[f"{self.path}/data/{r['folder']}" for r in found.values()]) if found else None


def export(rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame], batches: int = 16) -> dict[str, int]:
    """make(rows) as a table at path, in batches by a hash of the key: each is made and committed before the next one, and a run
    that finds some committed makes only the others. Raises ValueError if the rows of a committed batch have changed since, or if
    it was cut into another number of batches. Counts of batches and rows, made now and reused.
    """
    log = CommitLog(rows.sparkSession, path)
    log.discard_tail()
    done = log.records()
    if any(r.get("of") != batches for r in done.values()):
        raise ValueError(f"the export at {path} was begun with another number of batches")
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches))
    sums = rows.groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.col(key).cast("string"), F.lit("key")).cast("decimal(38,0)")).cast("string").alias("h"))
    now = {r["b"]: (r["n"], r["h"]) for r in sums.collect()}  # a row for each batch
    result = {"batches_made": 0, "batches_reused": 0, "rows_made": 0, "rows_reused": 0}
    for b in range(batches):
        n, h = now.get(b, (0, None))
        if b in done:
            if (done[b]["rows"], done[b]["keys"]) != (n, h):
                raise ValueError(f"rows of batch {b} have changed since it was written")
            kind = "reused"
        else:
            kind = "made" if log.commit(b, make(rows.where(part == b)), rows=n, keys=h, of=batches) else "reused"
        result[f"batches_{kind}"] += 1
        result[f"rows_{kind}"] += n
    return result


def sink(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query's writer whose micro-batches are the batches of a log: one that is run again adds nothing."""
    log = CommitLog(stream.sparkSession, path)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, b: log.commit(b, df) and None)
