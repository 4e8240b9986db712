from __future__ import annotations

import random

from lectern.llm import encoding as en

CLEAN = ["Le titre de {n} a été relevé à la deuxième lecture", "Für {n} fehlt die Überschrift der zweiten Ebene", "El índice de {n} señala una sección que no está", "Значение {n} сохранено как обычный текст", "Таблица {n} содержит много строк без подписи", "The café note — page {n} — doesn’t name it", "ÐÐ {n} is the label", "SEÇÃO {n}: DESCRIÇÃO DA FOLHA", "├── {n}.docx", "目录的第{n}项没有对应的章节", "La note liée renvoie à l’annexe {n}"]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("cp1251", "latin-1"), ("koi8-r", "cp1251")]


def garble(text: str, was: str, read_as: str) -> str | None:
    try:
        raw = text.encode(was)
    except UnicodeEncodeError:
        return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def cases() -> list[tuple[str, str, str | None]]:
    rng = random.Random(1)
    rows = []
    for i in range(700):
        clean = rng.choice(CLEAN).format(n=rng.randint(1, 40))
        rows.append((f"s{i}", clean, None))
        if i % 4 == 0:
            bad = garble(clean, *rng.choice(WRONG))
            if bad and bad != clean:
                rows.append((f"g{i}", bad, clean))
    rows += [("twice", garble(garble(CLEAN[0].format(n=1), "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[0].format(n=1)), ("lost", "Le titre a �t�", "")]
    return rows


def test_found_and_restored(spark):
    rows = cases()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in rows], "id string, text string, n int, key string")
    got = {r["text"]: r["restored"] for r in en.garbled_texts(df).collect()}
    assert set(got) == {t for _, t, clean in rows if clean is not None}
    right = [got[t] == clean for _, t, clean in rows if clean]
    assert sum(right) / len(right) > 0.97 and got["Le titre a �t�"] is None


def test_paragraphs_edges(spark):
    para = "array<struct<id:string,part:string,line_start:int,line_end:int,text:string,section_path:array<string>,heading_level:int,kind:string>>"
    row = lambda i, t: (i, "p", 1, 1, t, [], None, "text")
    clean = "Le titre de x a été relevé à la deuxième lecture où ça finit"
    held = [row("a", None), row("b", ""), row("c", garble(clean, "utf-8", "cp1252")), row("d", clean), row("e", "z" * 40000 + "�"), row(None, "�")]
    rows = [("s1", ("utf-8", held)), ("s1", ("utf-8", held)), ("s2", None), ("s3", (None, None))] + [(f"t{i}", ("x", [row("a", clean.replace("x", w)), row("b", garble(clean.replace("x", w), "utf-8", "cp1252"))])) for i, w in enumerate(["u", "v", "w"])]
    df = spark.createDataFrame(rows, f"source_id string, structure struct<encoding:string,paragraphs:{para}>")
    got = {(r["source_id"], r["para_id"]) for r in en.garbled_paragraphs(df, least=2).collect()}
    assert got == {("s1", "c"), ("s1", "e"), ("s1", None), ("t0", "b"), ("t1", "b"), ("t2", "b")}
    assert en.garbled_paragraphs(df.limit(0)).count() == 0


def test_signs_that_are_ascii_bytes_in_part(spark):
    """Bytes of one character may be letters, digits or brackets; the transformation is learned from others."""
    polish = ["Na stronie {n} znajduje się tylko rysunek.", "Strona {n} nie ma ani żadnego tytułu.", "Página {n} não é a última página", "La página {n} no está vacía"]
    clean = [t.format(n=n) for t in polish for n in "abcdefghijkl"]
    want = {garble(t.format(n=n), "gb18030", "cp1252"): t.format(n=n) for t in polish for n in "yz"}
    got = {r["text"]: r["restored"] for r in en.garbled_texts(spark.createDataFrame([(t,) for t in [*clean, *want]], "text string")).collect()}
    assert got == want


def test_whole_texts():
    japanese = ["ファイルnは本文の中に二回出てきます。", "9ページ目には図だけがあります。\nセルnには数式があり、結果は保存されていません。"]
    counts = {c: 50 for t in japanese for c in en.beyond(t)} | {"": 100} | {c: 40 for c in "éàè"}
    garbled = [garble(t, "cp932", "cp1252") for t in japanese]
    texts = [*garbled, *japanese, "été à la page", "", "plain"]
    assert en.whole_texts(texts, [("cp932", "cp1252"), ("mac-roman", "cp1252")], counts, 3).keys() == {0, 1}
    assert [x[0] for _, x in sorted(en.whole_texts(garbled, [("cp932", "cp1252")], counts, 3).items())] == japanese
    symbols = garble("«n» ¶ 3 § 4", "cp1252", "koi8-r")
    assert en.whole_texts([symbols], [("cp1252", "koi8-r")], {"": 100} | dict.fromkeys("«»¶§", 30) | dict.fromkeys("╚╩╤╖", 1), 3)[0][0] == "«n» ¶ 3 § 4"


def test_wrong_more_than_three_times():
    text = "Für"
    for _ in range(5):
        text = garble(text, "utf-8", "cp1252")
    known = {c for t in ["Für"] for c in en.beyond(t)} | {c for c in map(chr, range(0x80, 0x3000))}
    assert en.undo_all(text, ["cp1252"], known) == "Für"


def test_words_are_undone_together():
    words = ["relevé", "Значение", "中文", "¨¢", "ŽŠ", "xy"]
    for read_as in en.ENCODINGS[1:]:
        others = [x for x in en.ENCODINGS[1:] if x != read_as]
        want = {(i, was, out) for i, w in enumerate(words) for was in others for out in [en.undo(w, was, read_as)] if out and not out.isascii() and en.LOST not in out}
        assert set(en.undo_each(words, others, read_as)) == want


def test_mappings(spark):
    texts = [f"Le titre {n} a été relevé" for n in "abc"] * 2 + [f"Le titre {n} a Ã©tÃ© relevÃ©" for n in "abc"]
    rows = {(r["garbled"], r["clean"]) for r in en.mappings(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert rows == {("Ã©", "é")}


def test_alignment_and_explanation():
    assert en.align("relevÃ©", "relevé") == [("Ã©", "é")]
    assert en.align("a", "b") == []
    assert ("utf-8", "latin-1") in en.explain("Ã©", "é") and en.explain("é", "è") == []
    assert en.undo_all("FÃƒÂ¼r", ["cp1252"], {"ü", "Ã", "¼"}) == "Für"
    assert en.undo_utf8("SEÇÃO ÐÐ ├──", "cp1252", set("ÇÃÐ├─")) == "SEÇÃO ÐÐ ├──"
