from __future__ import annotations

import pytest

from lectern.llm import encoding as en

CLEAN = ["La página {n} sólo muestra el dibujo", "La sección {n} está vacía", "El índice {n} señala una versión más"]


@pytest.mark.parametrize(("was", "read_as"), [("gb18030", "cp1252"), ("mac-roman", "cp1252")])
def test_short_words_count_together(spark, was, read_as):
    clean = [t.format(n=n) for t in CLEAN for n in "abcdefgh"]
    garbled = {x: t.replace("ñ", "n") for t in (CLEAN[0].format(n="z") + ", está vacía", CLEAN[1].format(n="z") + ", sólo página") for x in [t.encode(was).decode(read_as)]}
    assert all(1 <= en.signs(w) <= 2 for t in garbled for w in en.words_of(t))
    alone = "Ni una p{} de texto".format("á".encode(was).decode(read_as) + "gina")  # one word of at most two signs proves nothing
    garbled |= {f"{next(iter(garbled))} {en.LOST}": None}
    rows = [(t,) for t in [*clean, *garbled, alone]]
    got = {r["text"]: r["restored"] for r in en.garbled_texts(spark.createDataFrame(rows, "text string")).collect()}
    assert got == garbled
