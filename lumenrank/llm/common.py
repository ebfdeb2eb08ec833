"""What the training-data operators share: shipping, shared storage, text buffers, connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Rows and bytes of one Arrow batch: short texts are bounded by the one, long ones by the other.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
#: Bytes of text that the numpy kernels take at once; their temporaries are 8 to 40 times as large.
BLOCK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on every executor and keep Arrow batches small. Safe to call often."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a session of one machine (local tests) gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lumenrank-shared-")
        atexit.register(shutil.rmtree, made, True)
        root = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lr_path = path
    if _open:
        _open[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    _delete(spark, df._lr_path)


#: Paths that materialise() wrote, by the scratch() blocks that are open.
_open: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written within the block are deleted at its end, but for those that are put into the list it gives.

    Within the block the shuffles of each written step are deleted with it, which halves the disk that is needed.
    """
    kept: list[DataFrame] = []
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    _open.append([])
    try:
        yield kept
    finally:
        spark.conf.set(_CLEANUP, before)
        left = {df._lr_path for df in kept}
        for path in _open.pop():
            if path not in left:
                _delete(spark, path)
            elif _open:
                _open[-1].append(path)


def hashable(df: DataFrame) -> list[str]:
    """Columns of df whose values have a hash."""
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def first_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of docs for each class, columns as they are: the smallest doc_id (a null one last), then the least hash of the text.

    members: doc_id, text_hash (text_hash(text)) and class for every row of docs; equal texts are in one class. Rows
    are known by doc_id and text, so rows that share an id are told apart, and of rows equal in both one stays.
    """
    rows = members.groupBy("doc_id", "text_hash").agg(F.count("*").alias("many"), F.min("class").alias("class"))
    rows = materialise(rows, "keys")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = materialise(rows.groupBy("class").agg(F.min(place).alias("best")), "best")
    met = rows.join(best, "class")
    same = place.eqNullSafe(F.col("best"))
    key = [F.col("doc_id").alias("_lr_id"), F.col("text_hash").alias("_lr_hash")]
    gone = materialise(met.where(~same).select(*key), "gone")
    twice = materialise(met.where(same & (F.col("many") > 1)).select(*key), "twice")
    own = docs.withColumn("_lr_own", text_hash(F.col("text")))

    def on(other: DataFrame):
        return own["doc_id"].cast("long").eqNullSafe(other["_lr_id"]) & (own["_lr_own"] == other["_lr_hash"])

    kept = own.join(gone, on(gone), "left_anti")
    if not twice.take(1):
        return kept.select(*[own[c] for c in docs.columns])
    lone = kept.join(twice, on(twice), "left_anti").select(*[own[c] for c in docs.columns])
    again = kept.join(twice, on(twice), "left_semi")
    row = F.min_by(F.struct(*[own[c] for c in docs.columns]), F.xxhash64(*[own[c] for c in hashable(docs)]))
    again = again.groupBy(own["doc_id"], own["_lr_own"]).agg(row.alias("_lr_row")).select("_lr_row.*")
    return lone.unionByName(again)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (one more than rows); null counts as empty."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + len(col) + 1)[col.offset :]
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together take about limit bytes; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, n)
        at = end


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of the edges (a, b), and for each the smallest id that it is connected with."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    lo, hi = np.minimum(inv[:n], inv[n:]), np.maximum(inv[:n], inv[n:])
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, hi, root[lo])
        np.minimum.at(root, lo, root[hi])
        np.minimum.at(root, before[hi], root[lo])  # hook the old roots as well, so trees merge in log steps
        np.minimum.at(root, before[lo], root[hi])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return ids, ids[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of edges only a star per connected part: at most one edge for each node."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        ids, root = union_find(np.concatenate(a), np.concatenate(b))
        keep = ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], ["u", "v"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += len(batch)
        if held >= 1 << 20:
            yield flush()
            a, b, held = [], [], 0
    if held:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the undirected edges (a, b) the smallest node it can reach.

    Alternating large-star and small-star steps; each step is an aggregation and an equi-join on node ids, and every
    round is cut off by a table in the shared folder, so a lost executor costs one round at most. Ends when a round
    changes nothing. Nodes without edges do not occur in the result.
    """
    spark = prepare(edges.sparkSession)
    pairs = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v")).where("u <> v")
    now = materialise(pairs.mapInArrow(_stars, "u long, v long"), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.groupBy("v").agg(F.max("v").alias("component")).select(F.col("v").alias("node"), "component")
            )
        seen = tuple(mark)
        # The minima are written before they are joined: then both sides of each join come straight from a shuffle,
        # and adaptive execution can split a hub that holds a large share of all edges.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = both.where("v > u").join(least, "u")
        large = materialise(joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        fewer = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "fewer")
        joined = large.join(fewer, "u")
        small = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialise(small, "edges")
        for old in (now, least, large, fewer):
            drop_shared(spark, old)
        now = after
