from __future__ import annotations

from datetime import datetime
from pathlib import Path

import duckdb
import pytest

from lectern.plans import journal

DATA = Path("/root/testdata/sf0.001")
UNIT = "unit_id string, revision bigint, arrived_at timestamp, fingerprint string, kind string, owner_id string, retired boolean"


def test_inventory_compares_every_unit(spark, tmp_path):
    at = datetime(2026, 1, 1)
    old = {"kept": ["f1", "f9"], "below the greatest": ["f1", "f9"], "greatest": ["f1", "f9"], "null": [None, "f9"], "null kept": [None, "f9"], "swapped": ["f1", "f9"], "gone": ["f1"], "one gone": ["f1", "f9"]}
    new = {"kept": ["f1", "f9"], "below the greatest": ["f2", "f9"], "greatest": ["f1", "f8"], "null": ["f1", "f9"], "null kept": [None, "f9"], "swapped": ["f9", "f1"], "come": ["f1"], "one gone": ["f1"]}
    rows = [(f"{o}{i}", 1, at, f, "paragraph", o, None) for o, held in old.items() for i, f in enumerate(held)]
    rows += [(f"{o}{i}", 2, at, f, "paragraph", o, False) for o, held in new.items() for i, f in enumerate(held)]
    rows += [("gone0", 2, at, "f1", "paragraph", "gone", True), ("one gone1", 2, at, "f9", "paragraph", "one gone", True)]
    rows += [("moved", 1, at, "f5", "paragraph", "from", None), ("moved", 2, at, "f5", "paragraph", "to", None), ("stays", 1, at, "f6", "paragraph", "from", None), ("stayed", 1, at, "f6", "paragraph", "to", None)]
    spark.createDataFrame(rows, UNIT).write.parquet(f"{tmp_path}/units.parquet")
    spark.createDataFrame([("succeeded", 1), ("failed", 2)], "status string, revision bigint").write.parquet(f"{tmp_path}/state_runs.parquet")
    got = [tuple(r) for r in journal.inventory_diff(spark, str(tmp_path)).collect()]
    want = {"below the greatest": "changed", "greatest": "changed", "null": "changed", "swapped": "changed", "gone": "removed", "come": "added", "one gone": "changed", "from": "changed", "to": "changed"}
    assert dict(got) == want and len(got) == len(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_inventory_equals_lists_of_units(spark):
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    held = "select owner_id, list({'unit': unit_id, 'f': fingerprint} order by unit_id) as held from"
    want = con.execute(f"""with {journal.BEFORE}, a as ({held} before group by 1), b as ({held} live group by 1)
        select coalesce(a.owner_id, b.owner_id), case when a.owner_id is null then 'added' when b.owner_id is null then 'removed' else 'changed' end
        from a full outer join b on a.owner_id = b.owner_id where a.held is distinct from b.held""").fetchall()
    assert sorted(tuple(r) for r in journal.inventory_diff(spark, str(DATA)).collect()) == sorted(want)
