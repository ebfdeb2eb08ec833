"""Every registered query against its SQL on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from lumenrank import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def cells(frame):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "-"
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return repr(float(v)) if math.isfinite(v) else str(v)
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    got = catalog.queries()[name](spark, small).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
