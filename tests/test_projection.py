"""The fold of a journal against walking it event by event, and the graph on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph as gr
from lectern.operators import index as ix
from lectern.operators import projection as pr

STAGES = ["initial", "deep"]


def journal(rng: random.Random) -> list[dict]:
    """Events with everything that may happen, in order."""
    out = []
    for revision in range(1, 13):
        unit = lambda: f"u{rng.randint(1, 5)}"
        out.append(
            {
                "revision": revision,
                "retire": [unit()] if rng.random() < 0.3 else [],
                "define": [(unit(), rng.choice("fgh"), rng.random() < 0.8, rng.random() < 0.2)] if rng.random() < 0.6 else [],
                "records": [(f"k{rng.randint(1, 4)}", revision)] if rng.random() < 0.5 else [],
                "reads": [(unit(), rng.choice(STAGES), rng.choice("fgh"))] if rng.random() < 0.6 else [],
                "again": [(unit(), rng.choice(STAGES))] if rng.random() < 0.3 else [],
                "recheck": [(f"k{rng.randint(1, 4)}", rng.randint(1, revision))] if rng.random() < 0.2 else [],
            }
        )
    return out


def walk(events, evidence, sources, depends, bound):
    """The same state, event by event."""
    units, records, history, reads, again, recheck = {}, {}, [], {}, set(), {}
    for e in events:
        for u in e["retire"]:
            if u in units:
                units[u] = (*units[u][:-1], True)
        for u, f, required, blocked in e["define"]:
            units[u] = (f, required, blocked, False)
        for k, version in e["records"]:
            if k in records:
                history.append((k, records[k]))
            records[k] = version
        for u, stage, f in e["reads"]:
            reads[u, stage] = f
            again.discard((u, stage))
        again |= set(e["again"])
        recheck.update({(k, v): "asked" for k, v in e["recheck"]})
    stale = {k: set() for k in records}
    for k in records:
        stale[k] |= {f"unit changed or missing: {u}" for x, u, f in evidence if x == k and (u not in units or units[u][-1] or units[u][0] != f)}
        stale[k] |= {f"source changed or missing: {s}" for x, s, held in sources if x == k and not held}
        stale[k] |= {f"revised: {on}" for x, on, v in depends if x == k and records.get(on) != v}
        stale[k] |= {"asked"} if (k, records[k]) in recheck else set()
    grown = True
    while grown:
        grown = False
        for k, on, _ in depends:
            if k in records and on in records and stale[on] and f"depends on {on}" not in stale[k]:
                stale[k].add(f"depends on {on}")
                grown = True
    cover = {}
    for u, (f, required, blocked, retired) in units.items():
        for stage in STAGES if required and not retired else []:
            read = reads.get((u, stage))
            if read == f:
                unsound = {on for x, s, on, v in bound if (x, s) == (u, stage) and (records.get(on) != v or stale.get(on))}
                cover[u, stage] = "needs_revalidation" if unsound or (u, stage) in again else "read"
            else:
                cover[u, stage] = "gap" if blocked else "needs_revalidation" if read else "unread"
    return units, records, sorted(history), {(k, r) for k, rs in stale.items() for r in rs}, cover


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_walking(spark, seed):
    rng = random.Random(seed)
    log = journal(rng)
    pick = lambda n, *xs: sorted({tuple(x() for x in xs) for _ in range(n)})
    k, u, v = (lambda: f"k{rng.randint(1, 4)}"), (lambda: f"u{rng.randint(1, 5)}"), (lambda: rng.randint(1, 12))
    evidence, depends, bound = pick(4, k, u, lambda: rng.choice("fgh")), pick(3, k, k, v), pick(4, u, lambda: rng.choice(STAGES), k, v)
    depends = [(a, b, c) for a, b, c in depends if a != b]
    sources = [("k1", "s1", True), ("k2", "s2", False)]
    units, records, history, stale, cover = walk(log, evidence, sources, depends, bound)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    flat = lambda name: [(e["revision"], *(x if isinstance(x, tuple) else (x,))) for e in log for x in e[name]]
    state = pr.replay(
        pr.Events(
            frame(flat("define"), "revision int, unit_id string, fingerprint string, required boolean, blocked boolean"), frame(flat("retire"), "revision int, unit_id string"),
            frame([(r, x, y) for r, x, y in flat("records")] * 2, "revision int, id string, version int"), frame([(*x, "read") for x in flat("reads")], "revision int, unit_id string, stage string, unit_fingerprint string, status string"),
            frame(flat("again"), "revision int, unit_id string, stage string"), frame(evidence, "id string, unit_id string, unit_fingerprint string"), frame(sources, "id string, source_id string, held boolean"),
            frame(depends, "id string, on string, version int"), frame([(x, y, "asked") for _, x, y in flat("recheck")], "id string, version int, reason string"), frame(bound, "unit_id string, stage string, on string, version int"),
        ),
        STAGES, F.col("blocked"),
    )
    assert {r["unit_id"]: (r["fingerprint"], r["required"], r["blocked"], r["retired"]) for r in state.units.collect()} == units
    assert {r["id"]: r["version"] for r in state.records.collect()} == records
    assert sorted((r["id"], r["version"]) for r in state.history.collect()) == history
    assert {(r["id"], r["reason"]) for r in state.stale.collect()} == stale
    assert {(r["unit_id"], r["stage"]): r["status"] for r in state.coverage.collect()} == cover


def test_checkpoint(spark, tmp_path):
    one = spark.createDataFrame([("u", 1)], "unit_id string, revision int")
    state = pr.State(*[one] * 6)
    folder = f"file://{tmp_path}/states"
    assert pr.load(spark, folder, "a") is None
    pr.save(state, folder, "a")
    assert [tuple(r) for r in pr.load(spark, folder, "a").units.collect()] == [("u", 1)] and pr.load(spark, folder, "b") is None


def test_graph_and_places(spark):
    units = spark.createDataFrame([("c", "p"), ("p", None), ("p", "p")], "unit_id string, parent_id string")
    evidence = spark.createDataFrame([("k", "c"), ("k", "c"), ("k", None)], "id string, unit_id string")
    relations = spark.createDataFrame([("k", "m", "uses")], "id string, target_id string, kind string")
    got = {tuple(r) for r in gr.graph(units, evidence, relations).collect()}
    half = {("c", "p", "paragraph_context"), ("k", "c", "claim_evidence"), ("k", "m", "knowledge_relation:uses")}
    assert got == half | {(b, a, r) for a, b, r in half}
    placed = spark.createDataFrame([("u1", "s", "main", 3), ("u2", "s", "main", 6), ("u3", "s", "notes", 3), ("v1", "t", "main", 1), ("v2", "t", "main", 9)], "unit_id string, owner_id string, part string, n int")
    places = gr.attachment_places(spark.createDataFrame([("O1", "s", "main", 4, "t")], "occurrence_id string, source_id string, part string, n int, child_owner string"), placed)
    assert {(r["side"], r["id"]) for r in places.collect()} == {("outer", "u1"), ("outer", "u2"), ("inner", "v1"), ("inner", "v2")}
    near = gr.neighbours(spark.createDataFrame([("u1", 4.0), ("u2", 8.0), ("c", 2.0)], "id string, score double"), gr.graph(units, evidence, relations), places)
    assert {(r["id"], r["via"], r["score"]) for r in near.collect()} == {("v1", "u2", 8.0), ("v2", "u2", 8.0), ("p", "c", 2.0), ("k", "c", 2.0)}


def test_index_leaves_out_what_does_not_hold(spark):
    units = spark.createDataFrame([("u", "clause", ["s"], "text", ["A", "B"], "m", ("p", "1"), False), ("r", "clause", ["s"], "t", [], None, None, True)], "unit_id string, kind string, source_ids array<string>, text string, section_path array<string>, metadata string, locator struct<part:string,paragraph:string>, retired boolean")
    records = spark.createDataFrame([("k", "rule", ["s"], "N", None, None, ["u1"], "x"), ("stale", "rule", ["s"], "N", "b", "c", [], "x")], "id string, kind string, source_ids array<string>, name string, body string, scope string, unknowns array<string>, review_status string")
    docs = {r["id"]: r for r in gr.index_documents(units, records, spark.createDataFrame([("stale", "r")], "id string, reason string")).collect()}
    assert set(docs) == {"u", "k"} and docs["u"]["section"] == "A > B" and docs["k"]["body"] == "" and docs["k"]["metadata"] == "u1"


def test_blocks_hold_whole_lists(spark):
    index = spark.createDataFrame([(i, "body", "hot", 1) for i in range(100)] + [(1, "name", "rare", 2)], "id int, field string, term string, tf int")
    blocks = ix.posting_blocks(index, "id", 10).collect()
    assert max(len(r["postings"]) for r in blocks) < 40
    assert sorted(p["id"] for r in blocks if r["term"] == "hot" for p in r["postings"]) == list(range(100))
    assert [[tuple(p) for p in r["postings"]] for r in blocks if r["term"] == "rare"] == [[(1, "name", 2)]]


def test_an_index_is_made_once_for_a_state(spark, tmp_path):
    docs = spark.createDataFrame([(1, "page image"), (2, "page")], "id int, body string")
    folder = f"file://{tmp_path}/index"
    one = ix.ensure_index(docs, folder, "a", "id", ["body"])
    assert ix.ensure_index(docs.limit(0), folder, "a", "id", ["body"]) == one
    got = ix.search(docs, "page image", fields=("body",), index=ix.stored_postings(spark, one, ["page", "image"])).collect()
    plain = ix.search(docs, "page image", fields=("body",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain)) and len(got) == 2
    two = ix.ensure_index(docs.where("id = 2"), folder, "b", "id", ["body"])
    assert two != one and ix.stored_postings(spark, two, ["page", "image"]).count() == 1
