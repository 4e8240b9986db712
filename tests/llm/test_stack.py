from __future__ import annotations

from lectern.llm import terms as tm


def test_stack_counts_the_records_of_single_terms():
    rows = [(["b"], 70, 2), (["b"], 80, 1), (["a"], 70, 5), (["a"], 90, 1), (["a"], 95, 1)]
    assert list(tm.stack_counts(iter(rows), 1)) == [(["b"], 3, 2), (["a"], 7, 3)]


def test_every_record_gets_to_the_stack(spark):
    rows = spark.createDataFrame([(i, ["a"], 1) for i in range(100)], "record int, terms array<string>, n bigint")
    counted = tm.suffix_counts(rows, longest=1, unique=True)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # only what adds up the parts
    assert [tuple(r) for r in counted.collect()] == [(["a"], 100, 100)]
