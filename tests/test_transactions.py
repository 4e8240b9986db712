from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import transactions as tr


def test_journal(spark, tmp_path):
    j = tr.Journal(spark, f"file://{tmp_path}/j")
    assert j.head() == (0, None)
    assert j.append(0, "reader", {"records": [{"id": "a"}], "reads": []}) == 1
    for bad in (False, 0, 2, "1"):
        with pytest.raises(tr.Conflict):
            j.append(bad, "reader", {"records": [1]})
    for model, payload in (("", {"records": [1]}), ("reader", {"records": []})):
        with pytest.raises(tr.Invalid):
            j.append(1, model, payload)
    wrong = spark.createDataFrame([("a", "name")], "subject string, rule string")
    with pytest.raises(tr.Invalid) as e:
        j.append(1, "reader", {"records": [1]}, wrong)
    assert e.value.args[0] == [("a", "name")]
    assert j.append(1, "reader", {"records": [2]}, wrong.where("false")) == 2
    assert j.broken() == [] and j.events().count() == 2
    with pytest.raises(Exception):  # noqa: B017
        j.store.publish("events/00000002.json", "{}")
    path = tmp_path / "j/events/00000001.json"
    held = json.loads(path.read_text())
    (tmp_path / "j/events/.00000001.json.crc").unlink()
    path.write_text(json.dumps(held | {"model": "readex"}, sort_keys=True))
    assert j.broken() == [("00000001.json", "digest")]


def test_quotes(spark):
    units = spark.createDataFrame([("u", "abcdef", "f", False), ("old", "x", "f", True), ("void", "", "f", False)], "unit_id string, text string, fingerprint string, retired boolean")
    refs = [("ok", "u", "f", 1, 3, "bc"), ("wrong", "u", "f", 1, 3, "xx"), ("far", "u", "f", 1, 30, "bc"), ("none", "u", "f", 0, 0, ""), ("changed", "u", "g", 1, 3, "bc"), ("gone", "nope", "f", 0, 1, "a"), ("retired", "old", "f", 0, 1, "x"), ("blank", "void", "f", 0, 0, ""), ("nulls", "u", "f", None, None, None)]
    got = {tuple(r) for r in tr.quote_violations(spark.createDataFrame(refs, "ref_id string, unit_id string, unit_fingerprint string, start int, end int, quote string"), units).collect()}
    assert got == {("wrong", "quote"), ("far", "range"), ("none", "empty quote"), ("changed", "fingerprint"), ("gone", "unit"), ("retired", "unit"), ("nulls", "range"), ("nulls", "empty quote")}


def test_views(spark):
    renditions = spark.createDataFrame([("r", "h", "page"), ("i", "h", "icon")], "rendition_id string, sha256 string, role string")
    views = spark.createDataFrame([("a", "r", "h", "eye", "seen"), ("b", "r", "old", "eye", "seen"), ("c", "i", "h", "", None)], "view_id string, rendition_id string, sha256 string, tool string, observation string")
    assert {tuple(r) for r in tr.view_violations(views, renditions).collect()} == {("b", "rendition"), ("c", "icon"), ("c", "tool"), ("c", "observation")}
    events = spark.createDataFrame([(1, "x", ("r",)), (1, "y", ("r",)), (2, "x", ("r",))], "revision int, record_id string, view struct<id:string>")
    kept, records = tr.compact_views(events)
    assert kept.count() == 2 and records.count() == 3


def test_blobs_and_rendition(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"bc"),), (None,)], "content binary")
    for _ in range(2):
        got = tr.store_blobs(rows, f"file://{tmp_path}/blobs").collect()
        assert sorted(r["bytes"] for r in got) == [1, 2]
    assert len([p for p in (tmp_path / "blobs").iterdir() if p.name[0] != "."]) == 2
    paras = spark.createDataFrame([("s", 2, "x < y", None, "1"), ("s", 1, "Top", 2, None)], "source_id string, n int, text string, heading_level int, num_id string")
    assert tr.reading_text(paras, ["n"]).first()["markdown"] == "## Top\n\n- x &lt; y"
    assert tr.reading_text(paras.where(F.lit(False)), ["n"]).count() == 0
