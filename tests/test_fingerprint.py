from __future__ import annotations

import hashlib
import json
from datetime import datetime

from lectern.plans import reading

UNIT = "unit_id string, kind string, owner_id string, locator struct<part:string,paragraph:string>, source_ids array<string>, text string, required boolean, section_path array<string>, fingerprint string, revision bigint, arrived_at timestamp, retired boolean"
NAMES = ["unit_id", "kind", "owner_id", "locator", "source_ids", "text", "required", "section_path", "fingerprint", "revision", "arrived_at", "retired"]
BASE = {"unit_id": "u", "kind": "clause", "owner_id": "s", "locator": {"part": "p", "paragraph": "L1"}, "source_ids": ["s"], "text": 'Ein "Satz" – 目\\', "required": True, "section_path": ["a"], "fingerprint": "f", "revision": 1, "arrived_at": datetime(2026, 1, 1), "retired": False}


def by_json(row: dict) -> tuple[str, int, str]:
    content = {k: v for k, v in row.items() if k not in ("fingerprint", "revision", "arrived_at")}
    return row["unit_id"], row["revision"], hashlib.sha256(json.dumps(content, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def found(spark, tmp_path, rows: list[dict]) -> list[tuple]:
    spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], UNIT).write.parquet(f"{tmp_path}/units.parquet")
    return sorted(tuple(r) for r in reading.unit_fingerprint(spark, str(tmp_path)).collect())


def test_every_column_counts(spark, tmp_path):
    changes = [{"kind": "gap"}, {"owner_id": "t"}, {"locator": {"part": None, "paragraph": "L1"}}, {"locator": {"part": "p", "paragraph": "L2"}}, {"locator": None}, {"source_ids": ["s", "t"]}, {"source_ids": None}, {"text": ""}, {"text": None}, {"text": "other"}, {"required": False}, {"section_path": []}, {"section_path": ["a", None]}, {"section_path": None}, {"retired": True}, {"retired": None}]
    rows = [BASE | c for c in [{}, *changes]]
    got = found(spark, tmp_path, rows)
    assert got == sorted(by_json(r) for r in rows) and len({h for _, _, h in got}) == len(rows)


def test_deliveries_of_one_row_have_one_hash(spark, tmp_path):
    rows = [BASE, BASE, BASE | {"arrived_at": datetime(2026, 1, 2)}, BASE | {"fingerprint": None}, BASE | {"revision": 2}]
    got = found(spark, tmp_path, rows)
    assert got == sorted({by_json(r) for r in rows}) and [r[1] for r in got] == [1, 2]
