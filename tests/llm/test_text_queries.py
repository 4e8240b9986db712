"""Queries of the subpackage with SQL give what the SQL gives, on the smallest tables; the others run."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lectern.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    df = q.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    assert got
    if name in q.oracle_sql():
        con = duckdb.connect()
        for p in DATA.iterdir():
            con.execute(f"create view {p.stem} as select * from '{p}'")
        rows = con.execute(q.oracle_sql()[name])
        names = [x[0] for x in rows.description]
        assert sorted(names) == columns
        assert got == sorted(str([r[names.index(c)] for c in columns]) for r in rows.fetchall())


def test_forms_of_found_queries(spark):
    want = {"p1_found": ["term", "mark"], "p2_found": ["entry_no", "term"], "p3_found": ["source_id", "para_id"], "p5_found": ["unit_id", "entry_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "start_pos", "end_pos"]}
    for name, columns in want.items():
        assert q.queries()[name](spark, str(DATA)).columns == columns
