from __future__ import annotations

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing as pk


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 60))
def test_plan_places_all(counts, capacity):
    ranges, containers = pk.plan(counts, capacity)
    used, ranks = defaultdict(list), defaultdict(set)
    for size, first, n, container, offset in ranges:
        for i in range(n):
            assert first + i not in ranks[size]
            ranks[size].add(first + i)
            used[container + i].append((offset, offset + size))
    assert {s: set(range(n)) for s, n in counts.items()} == dict(ranks)
    assert len(used) == containers
    for held in used.values():
        held.sort()
        assert all(a[1] == b[0] for a, b in zip(held, held[1:], strict=False)) and held[0][0] == 0 and held[-1][1] <= capacity
    # no two containers could be one
    fills = sorted(h[-1][1] for h in used.values())
    assert len(fills) < 2 or fills[0] + fills[1] > capacity or sum(fills) > capacity * (containers - 1) * 0.5


def packed(spark, items, windows):
    sizes = spark.createDataFrame([(*x, 0, 7) for x in items], "doc_id bigint, n_tokens bigint, container_id int, window_id int")
    return pk.pack(sizes, spark.createDataFrame(windows, "window_id int, capacity bigint")).collect()


def test_pack(spark):
    items = [(i, (i * 37) % 90) for i in range(400)] + [(1000, 250), (1001, 100), (1002, 0), (1003, 0)] + [(2000 + i, 30) for i in range(200)]
    got = packed(spark, items, [(1, 100), (1, 100), (2, 333), (3, 0), (4, None)])
    assert {r["window_id"] for r in got} == {1, 2}
    for w, capacity in ((1, 100), (2, 333)):
        rows = [r for r in got if r["window_id"] == w]
        by = defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
        for k, n in items:
            parts = sorted(by[k], key=lambda r: r["piece_no"])
            assert [p["start_token"] for p in parts] == [i * capacity for i in range(len(parts))]
            assert sum(p["n_tokens"] for p in parts) == n and (len(parts) == 1 or n > capacity)
        held = defaultdict(list)
        for r in rows:
            if r["n_tokens"]:
                held[r["container_id"]].append((r["container_offset"], r["container_offset"] + r["n_tokens"]))
        for spans in held.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        total = sum(n for _, n in items)
        assert total / (len(held) * capacity) > {100: 0.9, 333: 0.98}[capacity]


def test_fill_of_the_test_tables(spark):
    from pathlib import Path

    from lectern.llm import queries as q

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test tables")
    for r in q.p7_fill(spark, "/root/testdata/sf0.01").collect():
        assert r["fullest"] <= r["capacity"] and r["least"] <= r["containers"] <= r["least"] * 1.01 + 1


def test_windows_are_few(spark):
    with pytest.raises(ValueError, match="windows"):
        packed(spark, [(1, 1)], [(i, 10) for i in range(pk.MOST_WINDOWS + 1)])


def test_pack_edges(spark):
    assert packed(spark, [], [(1, 10)]) == []
    only_empty = packed(spark, [(1, 0)], [(1, 10)])
    assert [(r["doc_id"], r["n_tokens"], r["container_id"]) for r in only_empty] == [(1, 0, 0)]
    hot = packed(spark, [(i, 5) for i in range(3000)], [(1, 10)])
    assert len({r["container_id"] for r in hot}) == 1500


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_sizes_by_each_tokenizer(spark, name):
    from lectern.llm.queries import FOLDER

    docs = spark.createDataFrame([(1, "The page is blank."), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in pk.token_sizes(docs, name, FOLDER).collect()}
    assert 4 <= got[1] <= 7 and got[2] == 0 and got[3] == 0
