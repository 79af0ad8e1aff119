"""Every registered query against its DuckDB oracle on the driver's tables
(sf0.001 here to stay quick; tools/compare.py runs the same check at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF_SMALL):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    exp = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and {"risk_level", "health_score", "rul_days"} <= set(df.columns)


def test_every_query_reads_whole_tables():
    src = open(os.path.join(os.path.dirname(E.__file__), "wearcast", "plans", "queries.py")).read()
    for banned in (".limit(", ".sample(", "% 10", "mod("):
        assert banned not in src
