"""Every query with SQL gives what another engine gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from routelake.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(DIR):
        c.sql(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{DIR}/{x}'")
    return c


def rows(frame, cols):
    def plain(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)
