"""Every registered query against its SQL on the small tables, where these are at hand."""

import glob
import os

import numpy as np
import pytest

import __spark_entry__
from starloom import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert df.columns
        return
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
