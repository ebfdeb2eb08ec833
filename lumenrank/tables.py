"""Steps that are read twice: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session of one machine that has none gets a temporary one, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lumenrank-tables-")
        atexit.register(shutil.rmtree, made, True)
        root = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
