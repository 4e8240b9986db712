from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import index as ix
from lectern.operators import integrity as it
from lectern.operators import knowledge as kn
from lectern.operators import units as un


def test_fold_of_headings_and_fences(spark):
    text = "### Deep\n# Top\n## Sub\n```\n# no heading\n```\nend"
    rows = un.folded_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("line_no").collect()
    assert [r["kind"] for r in rows] == ["heading", "heading", "heading", "code", "code", "text", "text"]
    assert rows[0]["section_path"] == ["Deep"] and rows[2]["section_path"] == ["Top", "Sub"] and rows[4]["heading_level"] is None


def test_band_pairs(spark):
    a = spark.createDataFrame([("k", 5)], "k string, n int")
    b = spark.createDataFrame([("k", i) for i in range(1, 10)] + [("x", 5)], "k string, m int")
    assert sorted(r["m"] for r in un.band_pairs(a, b, ["k"], "n", "m", 2).collect()) == [3, 4, 5, 6, 7]


def test_occurrence_ids_are_global(spark):
    rows = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k int")
    got = un.occurrence_ids(rows, ["k"], parts=5).orderBy("k").collect()
    assert [r["occurrence_id"] for r in got] == [f"O{i:05d}" for i in range(1, 1001)]


edges_in = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12)


@settings(max_examples=5, deadline=None)
@given(edges_in)
def test_closure_with_cycles(spark, pairs):
    got = {(r["id"], r["ancestor"]) for r in kn.closure(spark.createDataFrame(pairs, "child int, parent int")).collect()}
    want = set()
    for x in {v for p in pairs for v in p}:
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += [b for a, b in pairs if a == y]
        want |= {(x, y) for y in seen}
    assert got == want


def test_staleness_spreads_through_cycles(spark):
    depends = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("e", "d")], "id string, on string")
    got = kn.spread(spark.createDataFrame([("a", "changed")], "id string, reason string"), depends)
    assert {(r["id"], r["reason"]) for r in got.collect()} == {("a", "changed"), ("b", "depends on a"), ("c", "depends on b"), ("b", "depends on c")}


ranges_in = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=8)


@settings(max_examples=5, deadline=None)
@given(st.lists(ranges_in, min_size=1, max_size=10), st.integers(1, 20))
def test_range_coverage(spark, groups, length):
    rows = [(k, min(r), max(r), length) for k, g in enumerate(groups) for r in g]
    got = {r["k"]: r["covered"] for r in it.range_coverage(spark.createDataFrame(rows, "k int, s int, e int, n int"), "k", "s", "e", "n").collect()}
    for k, g in enumerate(groups):
        held = {x for r in g for x in range(min(r), max(r))}
        # a range that starts beyond what was reached is a gap, even an empty one
        reach, gap = 0, False
        for s, e in sorted((min(r), max(r)) for r in g):
            gap |= s > reach
            reach = max(reach, e)
        assert got[k] == (not gap and set(range(length)) <= held)


def test_contiguous(spark):
    rows = [(1, 0, 3, 5), (1, 3, 5, 5), (2, 0, 2, 5), (2, 3, 5, 5), (3, 0, 4, 5)]
    got = {r["k"]: r["exact"] for r in it.contiguous(spark.createDataFrame(rows, "k int, s int, e int, n int"), ["k"], "s", "e", "n").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_diff_and_null_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, f string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (3, None), (5, "n")], "k int, f string")
    assert {(r["k"], r["change"]) for r in it.diff(a, b, "k", "f").collect()} == {(2, "changed"), (4, "removed"), (5, "added")}


def test_coverage_order_of_decisions(spark):
    units = spark.createDataFrame([("a", "f1", False), ("b", "f2", False), ("c", "f3", True), ("d", "f4", False)], "unit_id string, fingerprint string, blocked boolean")
    reads = spark.createDataFrame([("a", "initial", "f1", "read"), ("b", "initial", "old", "read"), ("c", "initial", "old", "read")], "unit_id string, stage string, unit_fingerprint string, status string")
    got = {r["unit_id"]: r["status"] for r in kn.coverage(units, reads, ["initial"], F.col("blocked")).collect()}
    assert got == {"a": "read", "b": "needs_revalidation", "c": "gap", "d": "unread"}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, body string, section string, kind string, source_ids array<string>")


def test_search_boundaries_aliases_pages(spark):
    docs = docs_of(spark, [(1, "", "Bids close. FAR applies.", "Rules", "clause", ["s"]), (2, "", "Farmwork is unrelated.", None, "clause", ["s"]), (3, "Far Authority", "An office.", "", "term", ["t"]), (4, None, None, None, None, None)])
    assert {r["id"] for r in ix.search(docs, "FAR").collect()} == {1, 3}
    assert {r["id"] for r in ix.search(docs, "bid").collect()} == {1}
    names = spark.createDataFrame([(3, "FAR"), (3, "office")], "id int, name string")
    assert {r["id"] for r in ix.search(docs, "FAR", names=names).collect()} == {1, 3}
    found = ix.search(docs, "FAR")
    first, second = ix.page(found, "id", 1, 0).collect(), ix.page(found, "id", 1, 1).collect()
    assert first[0]["id"] != second[0]["id"] and first[0]["total_hits"] == 2 and first[0]["next_offset"] == 1 and second[0]["next_offset"] is None
    assert ix.search(docs, "FAR", allowed=ix.eligible(docs, source="nowhere")).count() == 0
    edges = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    related = {r["id"]: r["score"] for r in ix.search(docs, "applies", edges=edges).collect()}
    assert related[2] == pytest.approx(related[1] * 0.25, abs=1e-4) and set(related) == {1, 2, 3}
    with pytest.raises(ValueError):
        ix.page(found, "id", 0)


def test_latest_and_history(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in kn.latest(rows, ["k"], ["n"], ["v"]).collect()} == {("a", "y"), ("b", "z")}
    assert [(r["k"], r["v"], r["version"]) for r in kn.history(rows, ["k"], ["n"]).collect()] == [("a", "x", 1)]


def test_first_wins(spark):
    rows = spark.createDataFrame([(2, "b", "h"), (1, "a", "h"), (3, "c", "i")], "n int, name string, sha string")
    got = {r["content"]: (r["n"], r["duplicate_names"]) for r in ix.first_wins(rows, F.col("sha"), ["n"], "name").collect()}
    assert got == {"h": (1, ["b"]), "i": (3, [])}


def test_chain(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, None), (4, 7, "c"), (5, 8, "c")], "n int, rev int, sha string")
    assert {(r["n"], r["rule"]) for r in kn.chain_violations(rows, [], ["n"], "rev", "sha").collect()} == {(2, "revision doesn't grow"), (3, "no digest"), (5, "digest repeated")}
