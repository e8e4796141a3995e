"""The registry: names, SQL, and agreement with DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry
from flowlens.plans import catalog

DATA = Path("/root/testdata/sf0.001")
SLOW = {"betweenness_by_joins"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 8) + 0.0
    return str(v)[:10] if isinstance(v, datetime.date) else v


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_against_duckdb(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(str([plain(row[names.index(c)]) for c in cols]) for row in found.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
