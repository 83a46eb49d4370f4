"""Every query with an SQL side gives the same rows as DuckDB on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def rows_of(df):
    def plain(v):
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.number)):
            return float(v)
        return v

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(map(repr, df.map(plain).itertuples(index=False, name=None)))


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 105


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns[:3] == ["txn_id", "user_id", "ts_ms"] and got.count() > 0
