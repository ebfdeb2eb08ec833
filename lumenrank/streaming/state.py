"""State that outlives a batch: a key-value cache fed by a stream, and a sink that takes up where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship


def kv_last(writes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """What a cache holds after all writes: each replaces what was there."""
    return writes.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def kv_cache(writes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A stream of (key, value, order) as updates of the cache: the latest value of each key that a batch touches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(writes.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in writes.schema.fields}

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for f in frames:
            top = f[order].max()
            if held is None or top >= held[1]:  # of rows that tie, the one that comes last
                held = (f[value][f[order] == top].iloc[-1], top)
        state.update(held)
        yield pd.DataFrame({key: [k[0]], value: [held[0]], order: [held[1]]})

    schema = ", ".join(f"{c} {fields[c]}" for c in (key, value, order))
    return writes.groupBy(key).applyInPandasWithState(update, schema, f"{value} {fields[value]}, {order} {fields[order]}", "update", GroupStateTimeout.NoTimeout)


def resumable_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """A query that appends to a Parquet table the rows whose key it does not hold yet; a batch that is run again adds nothing."""
    from ..sources.files import append_missing

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_missing(df.dropDuplicates([key]), path, key) and None)
