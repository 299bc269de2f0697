"""Registered finance queries against their DuckDB text on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from ledgerforge import catalog
from ledgerforge.plans.shapes import TABLES

NAMES = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def values(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)
