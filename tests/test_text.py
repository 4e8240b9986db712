from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as tx


def test_tokens():
    assert tx.token_list("Bids of FAR-12.b") == ["bids", "bid", "of", "far-12.b"]
    assert "far" not in tx.token_list("Farmwork")
    assert tx.token_list("status") == ["status"] and tx.token_list("bus") == ["bus"]
    assert tx.token_list("规则", indexing=False) == ["规则", "规则"]
    assert tx.token_list("规") == ["规", "规"]
    assert tx.token_list("débit αβ µs") == ["débit", "αβ", "μs"]


def plain_clauses(s: str) -> list[tuple[int, int, str]]:
    out, start, i = [], 0, 0
    while i < len(s):
        j = i + 1
        if s[i] in "。！？":
            while j < len(s) and s[j] in "。！？":
                j += 1
            cut = True
        elif s[i] in ".!?":
            cut = j == len(s) or s[j].isspace()
        else:
            cut = s[i] == "\n" and (j == len(s) or s[j] != "\n")
        i = j
        if cut:
            out.append((start, i, s[start:i]))
            start = i
    if start < len(s):
        out.append((start, len(s), s[start:]))
    return [x for x in out if x[2].strip()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab. !?。？\n", max_size=20), min_size=20, max_size=40))
def test_clauses_equal_stepping(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clauses(F.col("t")).alias("c")).collect()
    for r in rows:
        assert [(c["start"], c["end"], c["text"]) for c in r["c"]] == plain_clauses(r["t"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a\r\n\x0b\x1c\x85 \t", max_size=12), min_size=20, max_size=40))
def test_lines_equal_splitlines(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.lines(F.col("t")).alias("l")).collect()
    assert all(r["l"] == r["t"].splitlines() for r in rows)


def test_slices_and_ids(spark):
    df = spark.createDataFrame([("abcdef",)], "t string")
    r = df.select(*tx.text_slice(F.col("t"), F.lit(2), 3)).first()
    assert tuple(r) == ("cde", 6, 5)
    assert df.select(*tx.text_slice(F.col("t"), F.lit(4), 3)).first()["next_text_offset"] is None
    assert re.fullmatch("U[0-9a-f]{24}", df.select(tx.content_id("U", F.col("t")).alias("i")).first()["i"])
    assert df.select(tx.canonical(("b", F.lit(None).cast("int")), ("a", F.col("t"))).alias("j")).first()["j"] == '{"a":"abcdef","b":null}'
    kinds = spark.createDataFrame([("A.DOCX",), ("x.tsv",), ("y",), ("p.jpeg",)], "n string").select(tx.file_kind(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["docx", "csv", "unsupported", "image"]
