"""Every registered query against its SQL, on whole tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(repr(plain(row[c])) for c in sorted(df.columns)) for row in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(repr(plain(row[i])) for i in order) for row in cursor.fetchall()]
    assert sorted(got) == sorted(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
