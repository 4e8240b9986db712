"""Every query with comparison SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
CORE = {name: query for plan in entry.PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in entry.PLANS for name, sql in plan.SQL.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = CORE[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rows = db.execute(SQL[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(CORE) == set(SQL)


def test_entry_is_registered(spark):
    assert "search" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
