"""Checks of links and digests, receipts, and altered files, on small cases."""

from __future__ import annotations

import pytest

from lectern.operators import verify as vf
from lectern.sources import jsonl


def found(df):
    return sorted(tuple(r) for r in df.select("subject", "rule").collect())


def test_ids_and_hashes(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None), (None, "x"), (None, "y")], "id string, sha string")
    assert found(vf.duplicate_ids(rows, "id", "sha")) == [("b", "duplicate id")]
    stored = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None), ("s", "1"), (None, "1")], "path string, sha256 string")
    files = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "path string, sha256 string")
    assert found(vf.hash_check(stored, files)) == [("q", "mismatch"), ("s", "missing")]
    assert found(vf.hash_check(stored.limit(0), files)) == []


def test_content_links(spark):
    assets = spark.createDataFrame([("ok", "1", "s", "o"), ("changed", "2", "s", "o"), ("gone", "1", "x", "o"), ("parent", "1", "s", "other"), ("none", "1", None, "o"), ("null", "1", "n", "o")], "asset_id string, sha256 string, content_source_id string, owner string")
    sources = spark.createDataFrame([("s", "1", ["o"]), ("n", "1", None)], "source_id string, sha256 string, parents array<string>")
    assert found(vf.content_links(assets, sources)) == [("changed", "content source"), ("gone", "content source"), ("null", "parent"), ("parent", "parent")]


def test_receipts(spark):
    ranges = [("r1", "u", "f", 0, 10), ("r1", "u", "f", 0, 10), ("r1", "v", None, 0, 5), ("r2", "u", "f", 0, 10)]
    make = lambda rows: spark.createDataFrame(rows, "reader string, unit_id string, unit_fingerprint string, start int, end int")
    ids = {r["reader"]: r["receipt_id"] for r in vf.receipts(make(ranges), ["reader"]).collect()}
    assert ids == {r["reader"]: r["receipt_id"] for r in vf.receipts(make(ranges[::-1]), ["reader"]).collect()} and ids["r1"] != ids["r2"]
    claims = spark.createDataFrame([("r1", ids["r1"]), ("r2", ids["r1"]), ("r3", "Qnone"), ("r2", None)], "reader string, receipt_id string")
    assert found(vf.receipt_violations(claims, make(ranges), ["reader"])) == [("r2", "changed"), ("r2", "shape"), ("r3", "shape"), ("r3", "unknown")]


def test_altered_files_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/u"
    rows = spark.createDataFrame([("a", "x\u2028y"), ("b", None)], "id string, text string").coalesce(1)
    jsonl.write_units(rows, folder)
    read = lambda: sorted(tuple(r) for r in jsonl.read_checked(spark, folder, "id string, text string").select("id", "text").collect())
    assert read() == [("a", "x\u2028y"), ("b", None)]
    file = next((tmp_path / "u/data").glob("*.txt"))
    held = file.read_bytes()
    for crc in (tmp_path / "u/data").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(held.replace(b"x", b"z"))
    with pytest.raises(ValueError, match="mismatch"):
        read()
    file.write_bytes(held)
    (tmp_path / "u/data/more.txt").write_bytes(held)
    assert found(jsonl.altered_files(spark, folder)) == [("more.txt", "unknown")]
    file.unlink()
    assert ("missing" in {r for _, r in found(jsonl.altered_files(spark, folder))})
