from __future__ import annotations

import datetime as dt
import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import terms as tm

SHARDS = "shard_no int, term string, frequency bigint, postings array<struct<entry_no:bigint,field:string,n:int>>, built_at timestamp, n string"
A, B = dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 2)


def test_index_terms(spark):
    rows = [
        (1, "Page", 5, [(1, "body", 1), (1, "body", 1), (2, "section", 2)], B, "x"),
        (1, "ｐａｇｅ ", None, [(3, "body", 1)], B, "x"),
        (1, "page", 9, [(1, "body", 7)], A, "x"),
        (1, " ", 1, [(50, "body", 1)], B, None),
        (2, None, 1, [(51, "body", 1)], B, None),
        (2, "none", 1, None, B, None),
        (2, "rare", 1, [(4, None, None)], B, None),
        (2, "rare", 1, [(None, "body", 1)], None, None),
    ]
    got = {r["term"]: (r["frequency"], r["n_records"], r["mark"]) for r in tm.index_terms(spark.createDataFrame(rows, SHARDS)).collect()}
    assert got == {"page": (4, 3, "common"), "rare": (1, 1, "rare")}
    assert tm.index_terms(spark.createDataFrame([], SHARDS)).count() == 0


seqs = st.lists(st.tuples(st.integers(0, 5), st.lists(st.sampled_from("abc"), max_size=6), st.integers(1, 3)), max_size=12)


@settings(max_examples=8, deadline=None)
@given(seqs, st.integers(1, 3), st.integers(1, 4))
def test_suffix_counts_equal_counting(spark, rows, longest, salts):
    want_n, want_r = Counter(), defaultdict(set)
    for r, s, n in rows:
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + longest) + 1):
                want_n[tuple(s[i:j])] += n
                want_r[tuple(s[i:j])].add(r)
    df = spark.createDataFrame(rows, "record int, terms array<string>, n int")
    got = {tuple(r["terms"]): (r["frequency"], r["n_records"]) for r in tm.suffix_counts(df, longest, salts).collect()}
    assert got == {k: (n, len(want_r[k])) for k, n in want_n.items()}


ENTRIES = "entry_no bigint, body string, section string, term string, z int"


def test_record_terms_and_scores(spark):
    rows = [(1, "Apple apple ａｐｐｌｅ pie", "Pie"), (1, "Apple apple ａｐｐｌｅ pie", "Pie"), (2, "pie pie", None), (3, None, None), (4, "", "x" * 50000), (None, "apple", "")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], ENTRIES)
    counts = tm.record_terms(df)
    assert {(r["entry_no"], r["term"]): (r["n"], r["length"]) for r in counts.collect()} == {(1, "apple"): (3, 5), (1, "pie"): (2, 5), (2, "pie"): (2, 2), (4, "x" * 50000): (1, 1)}
    for hot in (1, 2, 4000):
        scored = {(r["entry_no"], r["term"]): r for r in tm.log_odds(counts, prior=10.0, hot_terms=hot).collect()}
        assert len(scored) == 4
        r = scored[1, "pie"]
        a, n, total, length, every = 4 / 8 * 10, 2, 4, 5, 8
        want = math.log((n + a) / (length + 10 - n - a)) - math.log((total - n + a) / (every - length + 10 - (total - n) - a))
        assert r["z"] == pytest.approx(want / math.sqrt(1 / (n + a) + 1 / (total - n + a)))
    assert scored[1, "apple"]["z"] > scored[1, "pie"]["z"]
    assert [(r["entry_no"], r["term"]) for r in tm.own_terms(tm.log_odds(counts)).collect()] == [(1, "apple")]
    assert tm.log_odds(tm.record_terms(df.limit(0))).count() == 0


def test_every_case_has_the_bound(spark):
    """What the score selects is what counting gives, on the smallest tables and for terms of all sizes."""
    rows = [(r, f"t{t}", n, 400) for r in range(40) for t in range(12) for n in [((r * 7 + t * 5) % 9) + (130 if r == t else 40 if r == t + 1 else 0)] if n]
    counts = spark.createDataFrame(rows, "entry_no int, term string, n bigint, length bigint")
    totals = Counter()
    for _, t, n, _ in rows:
        totals[t] += n
    want = {(r, t) for r, t, n, _ in rows if n >= 3 and n >= totals[t] / 4} | {(99, "only")}
    counts = counts.unionByName(spark.createDataFrame([(99, "only", 3, 3)], counts.schema))
    scored = tm.log_odds(counts)
    assert {(r["entry_no"], r["term"]) for r in tm.own_terms(scored, share=0.25).collect()} == want
    wide = {(r, t) for r, t, n, _ in rows if n >= 3 and n >= totals[t] / 10} | {(99, "only")}
    assert {(r["entry_no"], r["term"]) for r in tm.own_terms(scored, share=0.1).collect()} == wide and len(wide) > len(want) > 3


def test_records_of_prefixes_count_once():
    """A record with several suffixes counts once in each prefix, without sets."""
    rows = [(["b", "c"], 1, 1), (["b", "a"], 1, 1), (["b", "a"], 2, 1), (["b"], 2, 5), (["a", "b"], 1, 1), (["a"], 3, 1)]
    got = {tuple(t): (n, r) for t, n, r in tm.stack_counts(iter(rows), 2)}
    assert got == {("b", "c"): (1, 1), ("b", "a"): (2, 2), ("b",): (8, 2), ("a", "b"): (1, 1), ("a",): (2, 2)}


def test_stretches_across_batches(spark):
    """Postings of one term over many batches, with repeated and older ones."""
    rows = [(1, "hot", None, [(i, "body", 1), (i, "section", 2), (i, "body", 1)], B, "x") for i in range(30_000)] + [(1, "HOT", None, [(i, "body", 9)], A, "x") for i in range(100)] + [(1, f"t{i}", 1, [(i, None, None)], A, "") for i in range(500)]
    df = spark.createDataFrame(rows, SHARDS)
    for share in (1, 64):
        got = {r["term"]: (r["frequency"], r["n_records"], r["mark"]) for r in tm.index_terms(df, share=share).collect()}
        assert got == {"hot": (90_000, 30_000, "common")} | {f"t{i}": (1, 1, "rare") for i in range(500)}
