"""How a catalogue module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The test tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a function of Tables under its name, with its SQL."""

        def wrap(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded so that the order of summation can't show; never -0."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), digits) + 0.0).alias(name)
