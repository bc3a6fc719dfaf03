"""Every registered query of the engine against the same question put to DuckDB."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

from tessera import queries as registered

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (bytes, bytearray)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (float, decimal.Decimal)):
        return format(float(v) + 0.0, ".9g")
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.execute(ORACLE[name]).df())
