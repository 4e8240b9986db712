from __future__ import annotations

import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import consistent as co

one = lambda s: co.consistent([s])[0]


def test_same_look():
    base = "Ref 12: the café of naïve firms, page K"
    for other in ("Ref 12: the café of naïve ﬁrms, page K", "Rеf 12: thе сafé оf naïvе firmѕ, раgе К", "Ｒｅｆ １２: ｔｈｅ café of naïve firms, page K", "R​e­f 1⁠2: the café of naïve fir﻿ms, page　K"):
        assert one(other) == one(base)
    for other in ("Ref 12: the cafe of naïve firms, page K", "ref 12: the café of naïve firms, page K", "Ref 13: the café of naïve firms, page K", "Ref 12; the café of naïve firms, page K", "Ref 12: the café of naïve firms， page K"):
        assert one(other) != one(base)


def test_scripts_stay():
    russian = "Значение сохранено как обычный текст, а не с ошибкой."
    assert one(russian) == russian and one(russian.replace("о", "o").replace("е", "e")) == russian
    greek = "Το σχόλιο της παραγράφου"
    assert one(greek) == greek
    assert one("Лист trekotre скрыт") == "Лист trekotre скрыт"
    assert one("ｶﾞ が ⼀ 한글") == "ガ が 一 한글" == one("ガ が 一 한글")
    assert one("क्‍ष 👩‍💻") == "क्‍ष 👩‍💻"


def test_words_of_capitals_keep_their_script():
    rest = "Лист скрыт, но его текст читается полностью"
    for name in ("pezanopo", "KOKATIKA", "TIBATOPE", "MENAMETI"):  # Z, N and I are no letters of this text
        assert one(f"{rest} ({name})") == f"{rest} ({name})"
    assert one(f"{rest}: komate, KOMATE") == f"{rest}: komate, KOMATE"  # k, m and t show that it is Latin
    assert one(f"{rest}: КОТ") == f"{rest}: КОТ" == one(f"{rest}: KOT")
    assert one("Το σχόλιο ΤΟΝΕ") == "Το σχόλιο ΤΟΝΕ" == one("Το σχόλιο TONE")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_batches_are_single_texts_and_stable(texts):
    got = co.consistent(texts)
    assert got == [one(t) for t in texts]
    assert [one(x) for x in got] == got
    assert all(ud.is_normalized("NFC", x) for x in got if not set(x) & {"̸"})


def brute(units, entries):
    return {(u, e) for u, t in units for e, b in entries if u is not None and e is not None and t and b and t != b and one(t) == one(b) and one(t).strip()}


def test_pairs(spark):
    units = [("u1", "Page K"), ("u1", "Page K"), ("u2", "раge"), ("u3", None), ("u4", ""), ("u5", "​"), ("u6", "page" * 9000), (None, "Page K"), ("u1", "Page K")]
    entries = [("e1", "Page K"), ("e1", "Page K"), ("e2", "page"), ("e3", "Page K"), ("e4", " "), ("e5", None), ("e6", "page" * 8999 + "раge")]
    a = spark.createDataFrame([(*x, "f") for x in units], "unit_id string, text string, form string")
    b = spark.createDataFrame([(*x, 1) for x in entries], "entry_id string, body string, text int")
    got = {tuple(r) for r in co.look_alike_pairs(a, b, "unit_id", "text", "entry_id", "body").collect()}
    assert got == brute(units, entries) and ("u1", "e1") in got and ("u2", "e2") in got and ("u6", "e6") in got
    assert co.look_alike_pairs(a.limit(0), b, "unit_id", "text", "entry_id", "body").count() == 0


def test_pairs_of_equal_texts_are_never_made(spark):
    """A text that many rows share meets none of its own kind, only the one that differs."""
    a = spark.createDataFrame([(f"u{i}", "page") for i in range(400)] + [("v", "раge")], "unit_id string, text string")
    b = spark.createDataFrame([(f"e{i}", "page") for i in range(400)], "entry_id string, body string")
    found = co.look_alike_pairs(a, b, "unit_id", "text", "entry_id", "body")
    assert {r["unit_id"] for r in found.collect()} == {"v"} and found.count() == 400


def test_with_form(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ｘ")], "n int, text string")
    assert [r["form"] for r in co.with_form(df).orderBy("n").collect()] == [None, "", "x"]
