"""Lines of many files with their places, so that "the first", "the last wins" and "a limit" hold however the files are split.

A place is (file, block, line): the file's path, the byte at which the split that the line was read from begins, and a number
that grows within the split. Places sort as the lines stand in the files, files by their paths; nothing is read twice, and
the reader is Spark's own, so it reads every store that Spark does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def place_of_row() -> Column:
    """The place of a row that a file reader gives; for the reader's own frame, before anything else."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_lines_at(spark: SparkSession, *paths: str) -> DataFrame:
    """(place, text) of all lines of text files."""
    return spark.read.text(list(paths)).select(place_of_row().alias("place"), F.col("value").alias("text"))


def read_json_at(spark: SparkSession, schema: str | T.StructType, *paths: str) -> DataFrame:
    """place and the fields of JSON lines; a line that is no JSON fails the read, a blank one is left out."""
    lines = read_lines_at(spark, *paths).where(F.trim("text") != "")
    return lines.select("place", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("o")).select("place", "o.*")


def starts_file() -> Column:
    """Whether a line may be the first of its file: no other line of its split is needed to tell."""
    return F.col("place.block") == 0


def first_lines(rows: DataFrame) -> DataFrame:
    """place of the first line of each file, as (file, line)."""
    return rows.where(starts_file()).groupBy("place.file").agg(F.min("place.line").alias("line"))


def limit_at(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by place: a top-n, not a sort."""
    return rows.orderBy("place").limit(n)


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one that stands last."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "place").alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one that stands first."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "place").alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])
