"""Vector exports from files to committed batches: texts, the windows of series, the windows of event traces.

Every driver reads its format, makes the texts that are embedded, and exports (id, vector) or (parent_id, child_id, vector) by
sources.commitlog.export(): a run that was cut off embeds only the batches that it had not committed.

embed: a function from (doc_id, text) to (doc_id, vector), like lambda d: encoder.embed_texts(d, model, weights).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunking
from ..sources import commitlog, files

Embed = Callable[[DataFrame], DataFrame]


def _vectors(texts: DataFrame, embed: Embed, dims: int | None) -> DataFrame:
    """(doc_id, vector) at unit length, cut to dims components if told."""
    cut: Column = V.prefix(F.col("vector"), dims) if dims else V.normalize(F.col("vector"))
    return embed(texts.select("doc_id", "text")).select("doc_id", cut.alias("vector"))


def _children(rows: DataFrame, out: str, embed: Embed, dims: int | None, batches: int) -> dict[str, int]:
    """rows (parent_id, child_id, text): a parent's children are in one batch."""

    def make(part: DataFrame) -> DataFrame:
        made = _vectors(part.select(F.col("child_id").alias("doc_id"), "text"), embed, dims).withColumnRenamed("doc_id", "child_id")
        return part.select("parent_id", "child_id").join(made, "child_id").select("parent_id", "child_id", "vector")

    return commitlog.export(rows, out, "parent_id", make, batches)


def export_texts(spark: SparkSession, path: str, out: str, embed: Embed, prefix: str = "", dims: int | None = None, ids: DataFrame | None = None, limit: int | None = None, batches: int = 16) -> dict[str, int]:
    """(id, vector) of a corpus or query file; each text, its white space as single spaces, follows the prefix."""
    rows = files.read_texts(spark, path, ids, limit).select("id", F.concat(F.lit(prefix), X.collapse(F.col("text"))).alias("text"))

    def make(part: DataFrame) -> DataFrame:
        return _vectors(part.withColumnRenamed("id", "doc_id"), embed, dims).withColumnRenamed("doc_id", "id")

    return commitlog.export(rows, out, "id", make, batches)


def _window_id(parent: Column, start: Column) -> Column:
    return F.concat(parent, F.lit("#window-"), chunking.chunk_number(start))


def export_series(spark: SparkSession, path: str, out: str, embed: Embed, width: int, stride: int, dims: int | None = None, batches: int = 16) -> dict[str, int]:
    """(parent_id, child_id, vector) of the windows of a file of series; a window is rendered with its place, values and statistics."""
    series = files.read_series(spark, path)
    windows = chunking.render_series(series, chunking.numeric_windows(series, width, stride))
    return _children(windows.select(F.col("id").alias("parent_id"), _window_id(F.col("id"), F.col("start")).alias("child_id"), "text"), out, embed, dims, batches)


def export_traces(spark: SparkSession, path: str, out: str, embed: Embed, width: int, stride: int, dims: int | None = None, batches: int = 16) -> dict[str, int]:
    """(parent_id, child_id, vector) of the windows over the events of a file of traces."""
    windows = chunking.trace_windows(files.read_traces(spark, path).select("id", "pos", "text"), width, stride)
    return _children(windows.select(F.col("id").alias("parent_id"), _window_id(F.col("id"), F.col("start")).alias("child_id"), "text"), out, embed, dims, batches)


def read_export(spark: SparkSession, out: str) -> DataFrame | None:
    """What is committed of an export."""
    return commitlog.CommitLog(spark, out).read()
