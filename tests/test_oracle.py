"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import glob
import os

import pytest

from sightline.plans import envelope, machines, relations, replay, signals, traffic
from tests.conftest import DATA

PLANS = {n: (f, p.SQL.get(n)) for p in (traffic, envelope, signals, relations, machines, replay) for n, f in p.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return None if v != v else f"{float(v):.8g}"
    return None if v is None else f"{v:.8g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 10**7 else str(v)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql))
def test_rows_equal_sql(spark, duck, name):
    query, sql = PLANS[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(v) or "" for v in r) for r in df.select(*columns).collect())
    theirs = sorted(tuple(plain(r[i]) or "" for i in at) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if not sql))
def test_rows_only(spark, name):
    assert PLANS[name][0](spark, DATA).count() > 0


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(PLANS) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
