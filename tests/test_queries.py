"""Every registered query against its SQL, on the small tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    cursor = sql.execute(ORACLES[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith(("op", "pipeline"))))
def test_without_sql(spark, sf, name):
    """Rows, and the same rows again (their values are held against brute force in test_brute, test_graphs and test_tables)."""
    rows = lambda: sorted((tuple(plain(v) for v in r) for r in QUERIES[name](spark, sf).collect()), key=str)
    first = rows()
    assert first and first == rows()


def test_entry_names():
    assert set(ORACLES) <= set(QUERIES) and "fingerprint3" in QUERIES
