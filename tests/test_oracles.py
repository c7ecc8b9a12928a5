"""Every registered query with SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quern.plans import registry

FOLDER = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _shown(value):
    if value is None or value is pd.NaT or value != value:
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_shown(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = registry.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    numeric = [c for c in ours.columns if pd.api.types.is_float_dtype(ours[c]) or pd.api.types.is_float_dtype(theirs[c])]
    for c in numeric:
        ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    assert rows_of(ours) == rows_of(theirs)
