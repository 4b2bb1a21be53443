"""Every core query that SQL can express, against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from pramana.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


def _rows(df):
    return sorted(str(tuple(_cell(v) for v in row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, con, name):
    assert registry.queries()[name](spark, DATA).limit(5).count() >= 0
