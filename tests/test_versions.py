from __future__ import annotations

import datetime as dt

import pytest

from lectern.operators.versions import Overtaken, VersionedTable, next_units, run_once


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_and_changes(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    make = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    assert t.latest().version == 0 and t.read() is None
    one = t.put_snapshot(make(("a", "1"), ("b", "1"), ("c", "1"), ("c", "1")), "k")
    two = t.put_snapshot(make(("a", "1"), ("b", "2"), ("d", "1")), "k")
    assert rows(t.read(one)) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert rows(t.read()) == [("a", "1"), ("b", "2"), ("d", "1")]
    assert rows(t.changes(one, two)) == [("delete", "b", "1"), ("delete", "c", "1"), ("insert", "b", "2"), ("insert", "d", "1")]
    three = t.compact()
    assert rows(t.read(three)) == rows(t.read(two))
    assert rows(t.changes(two, three)) == []
    assert rows(t.changes(one, three)) == rows(t.changes(one, two))
    same = t.put_snapshot(make(("a", "1"), ("b", "2"), ("d", "1")), "k")
    moved = t.changes(three, same)
    assert moved is None or rows(moved) == []
    four = t.put_snapshot(make(("a", None), ("b", "2")), "k")
    assert rows(t.changes(same, four)) == [("delete", "a", "1"), ("delete", "d", "1"), ("insert", "a", None)]
    assert rows(t.read(t.put_snapshot(make().limit(0), "k"))) == []


def test_versions_are_published_once(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.append(spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(Exception):  # noqa: B017
        t.store.publish("manifests/0000000001.json", "{}")


def test_runs_survive_failures(spark, tmp_path):
    src, out = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/out")
    src.append(spark.createDataFrame([("a", 1)], "k string, v int"))

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_once(src, out, fails)
    assert out.latest().version == 0
    take = lambda df: df.select("change", "k", "v")
    assert run_once(src, out, take).notes == {"processed": 1}
    assert run_once(src, out, take) is None
    src.put_snapshot(spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int"), "k")
    src.append(spark.createDataFrame([("c", 1)], "k string, v int"))
    run_once(src, out, take)
    assert rows(out.read()) == [("delete", "a", 1), ("insert", "a", 1), ("insert", "a", 2), ("insert", "b", 1), ("insert", "c", 1)]


def test_a_run_that_is_overtaken_starts_over(spark, tmp_path):
    src, out = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/out")
    src.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    take = lambda df: df.select("change", "k", "v")
    calls = []

    def slow(df):
        calls.append(df.count())
        if len(calls) == 1:  # another run takes the same rows before this one publishes
            assert run_once(src, VersionedTable(spark, out.path), take).version == 1
            src.append(spark.createDataFrame([("b", 2)], "k string, v int"))
        return take(df)

    made = run_once(src, out, slow)
    assert calls == [1, 1] and made.version == 2 and made.notes == {"processed": 2}
    assert rows(out.read()) == [("insert", "a", 1), ("insert", "b", 2)]
    assert len(out.store.names("data")) == 2  # what the overtaken attempt wrote is gone
    assert run_once(src, out, take) is None


def test_an_overtaken_run_with_nothing_left_is_done(spark, tmp_path):
    src, out = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/out")
    src.append(spark.createDataFrame([("a", 1)], "k string, v int"))

    def slow(df):
        if not out.latest().version:
            run_once(src, VersionedTable(spark, out.path), lambda x: x)
        return df

    assert run_once(src, out, slow) is None
    assert rows(out.read()) == [("insert", "a", 1)]


def test_appending_to_an_old_version_fails(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    base = t.append(spark.createDataFrame([(1,)], "k int"))
    t.append(spark.createDataFrame([(2,)], "k int"))
    with pytest.raises(Overtaken):
        t.append(spark.createDataFrame([(3,)], "k int"), base=base)
    assert rows(t.read()) == [(1,), (2,)]


def test_versions_write_what_changed(spark, tmp_path):
    """Parts and vectors of rows that stay are used again; many small parts are put together."""
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    make = lambda lo, hi, v: spark.createDataFrame([(i, v) for i in range(lo, hi)], "k int, v string")
    one = t.append(make(0, 50, "x"))
    two = t.append(make(50, 100, "x"))
    assert set(one.parts) < set(two.parts)
    three = t.put_snapshot(make(0, 99, "x"), "k")
    four = t.put_snapshot(make(0, 98, "x"), "k")
    assert max(len(v) for v in four.files.values()) == 2 and all(len(v) <= 1 for v in three.files.values())
    assert rows(t.changes(two, four)) == [("delete", 98, "x"), ("delete", 99, "x")]
    assert rows(t.changes(three, four)) == [("delete", 98, "x")]
    assert set(four.parts) & set(one.parts)
    held = [[r.file for r in spark.read.parquet(v).selectExpr("__file as file").collect()] for vs in four.files.values() for v in vs]
    assert [len(x) for x in held] == [1, 1]
    for i in range(70):
        t.append(make(i + 200, i + 201, "y").coalesce(1))
    last = t.latest()
    assert len(last.parts) <= 65 and t.read().count() == 168
    assert t.changes(four, last).count() == 70


def test_merge_touches_only_its_keys(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    make = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    t.merge(make(("a", "1"), ("b", "1")), "k")
    one = t.latest()
    two = t.merge(make(("b", "2"), ("c", "1"), ("c", "1"), (None, "n")), "k")
    assert rows(t.read().where("k is not null")) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert t.read().count() == 4 and t.changes(one, two).where("change = 'delete'").count() == 1
    t.merge(make((None, "m"), ("a", "1")), "k")
    assert t.read().where("k is null").first()["v"] == "m" and t.read().count() == 4


UNITS = "unit_id string, fingerprint string, revision bigint, arrived_at timestamp, retired boolean, note string"
READS = "unit_id string, unit_fingerprint string, run_no bigint, attempt int, noted_at timestamp, status string"
RUNS = "run_no bigint, attempt int, status string"
T = dt.datetime(2031, 1, 1)


def test_units_for_the_next_run(spark, tmp_path):
    units = [("same", "f", 1, T, False, "x"), ("new", "f", 1, T, None, None), ("changed", "f", 1, T, False, ""), ("changed", "g", 2, T, False, ""), ("changed", "g", 2, T, False, ""), ("gone", "f", 3, T, True, ""), ("null", None, 1, T, False, ""), ("back", "f", 1, T, False, ""), ("failed", "f", 1, T, False, ""), (None, "f", 1, T, False, "")]
    reads = [("same", "f", 1, 2, T, "gap"), ("changed", "f", 1, 2, T, "read"), ("back", "f", 1, 2, T, "read"), ("back", "e", 2, 1, T, "read"), ("failed", "f", 1, 1, T, "read"), ("gone", "e", 1, 2, T, None)]
    runs = [(1, 1, "failed"), (1, 2, "succeeded"), (1, 2, "succeeded"), (2, 1, "succeeded"), (3, 1, "running")]
    got = next_units(spark.createDataFrame(units, UNITS), spark.createDataFrame(reads, READS), spark.createDataFrame(runs, RUNS), f"file://{tmp_path}/v")
    assert rows(got) == [("back", "f"), ("changed", "g"), ("failed", "f"), ("new", "f")]


def test_the_second_run_reads_only_what_came(spark, tmp_path):
    """Files of the first delivery may even be gone."""
    import shutil

    make = lambda *x: spark.createDataFrame(list(x), UNITS)
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    make(("a", "f", 3, T, False, ""), ("b", "f", 1, T, False, ""), ("c", "f", 1, T, True, "")).write.parquet(first)
    make(("a", "e", 2, T, False, ""), ("b", "g", 2, T, False, ""), ("c", "f", 2, T, False, ""), ("d", None, 1, T, False, "")).write.parquet(second)
    reads, runs = spark.createDataFrame([], READS), spark.createDataFrame([], RUNS)
    at = f"file://{tmp_path}/v"
    assert rows(next_units(spark.read.parquet(first).inputFiles(), reads, runs, at)) == [("a", "f"), ("b", "f")]
    shutil.rmtree(first)
    # a late row with a lower revision is no change; one that came back is due
    assert rows(next_units(spark.read.parquet(second).inputFiles(), reads, runs, at)) == [("b", "g"), ("c", "f")]
    assert rows(next_units([], reads, runs, at)) == []


def test_no_units_and_nothing_read(spark, tmp_path):
    empty = [spark.createDataFrame([], s) for s in (UNITS, READS, RUNS)]
    assert rows(next_units(*empty, f"file://{tmp_path}/a")) == []
    one = spark.createDataFrame([("u", "f", 1, T, False, "")], UNITS)
    assert rows(next_units(one, empty[1], empty[2], f"file://{tmp_path}/b")) == [("u", "f")]
