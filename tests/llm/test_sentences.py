from __future__ import annotations

import random
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import sentences as se

# sentences of many kinds; texts are put together from them, so the true places are known
PARTS = [
    "The run ended at 4 p.m.", "Every page had been read by then.", "Dr. Orlo met Mr. Tarn at the annex.", "Values such as 3.14 were kept, e.g. in cell B2.", "No.", "No. 7 has no caption.", "Really?!", "Reading stopped after page 255.",
    'The reviewer wrote: "Row 3 is blank. Please look again."', "“Stop! The page is torn,” said the reader.", "“Nothing is left.”", "(See Sec. 4 for the page.)", "The (see p. 3!) remark stays.", "It holds notes, tables, etc.",
    "The file a_v2.final.md was renamed.", "Siehe Abb. 3 und Kap. 4 zu xy.", "Im 2. Kapitel steht: „Siehe S. 3.“", "Das betrifft u. a. Spalte C, d. h. die zweite.", "Pourquoi ?", "« Le tableau est-il masqué ? » demande la lectrice.",
    "¿Está oculta la hoja?", "«¿Se leyó el texto?», preguntó la lectora.", "Стр. 3 и др. не прочитаны.", "А. К. Тарн прочёл стр. 4 дважды.", "Είναι κρυφό το φύλλο;", "Βλ. σελ. 3 και εικ. 4 για το θέμα.", "صفحة واحدة ناقصة؟", "यह पृष्ठ खाली है।",
]
TIGHT = ["第3页缺失！", "读者说：“在哪里？”", "“过期了吗？”评审人问。", "（参见第3节。）", "数值为3.5，见表2。", "本当ですか？", "担当者は「空です。もう一度。」と書いた。", "版本已保存……随后关闭。"]
THAI = ["ตาราง abc ไม่มีหัวข้อ", "ข้อความฉบับเก่ายังมีคำ", "หน้าที่ 12 มีภาพเพียงภาพเดียว", "ผู้อ่านยังไม่พบหน้า"]


def made(rng: random.Random) -> tuple[str, list[str]]:
    blocks, truth = [], []
    for _ in range(rng.randint(1, 5)):
        parts, sep = rng.choice([(PARTS, " "), (PARTS, " "), (PARTS, "\n"), (TIGHT, ""), (THAI, " ")])
        own = [rng.choice(parts) for _ in range(rng.randint(1, 5))]
        head = rng.choice(["", "", "- ", "# Head. Two\n", "| a. B | c. D |\n", "```\nx = 1. Y\n```\n"])
        if head in ("", "- "):
            truth += [head + own[0], *own[1:]]
        else:
            truth += [head.strip(), *own]
        blocks.append(head + sep.join(own))
    return "\n\n".join(blocks), truth


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    return se.train([made(rng)[0] for _ in range(1500)])


def test_held_out(model):
    rng = random.Random(99)
    right = total = 0
    for _ in range(400):
        text, truth = made(rng)
        got = [text[a:b] for a, b in se.sentences(text, model)]
        total += len(truth)
        right += len(truth) if got == truth else sum(x in got for x in truth)
    assert right / total > 0.98, right / total


@pytest.fixture(scope="module")
def trained():
    """The model of the documents of the test data."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    texts = [x for x in pq.read_table(path, columns=["text"]).column(0).to_pylist() if x and x.strip()]
    return se.train(sorted(texts)), " ".join(texts).lower()


#: Sentences whose abbreviations no training text has; each is one sentence.
UNSEEN = ["The dept. of state.", "The govt. said so.", "Zobacz np. rozdział 2.", "The U.N. charter is old.", "Пример, т. е. образец.", "Ave. Foch is closed.", "Gov. Brown spoke.", "Bldg. 7 is closed.", "He met Gov. Brown in Bldg. 7.", "Siehe Anm. 4 dazu."]


def test_abbreviations_that_training_lacks(trained):
    model, seen = trained
    assert not any(f" {w.lower()} " in seen for text in UNSEEN for w in text.split()[:-1] if w[-1] == "." and len(w) > 2)
    got = {text: [text[a:b] for a, b in se.sentences(text, model)] for text in UNSEEN}
    assert sum(len(x) == 1 for x in got.values()) >= 9, got
    assert all(len(got[x]) == 1 for x in UNSEEN[:5])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["The", "page", "dept.", "U.N.", "no.", "really?", "stop!", "(see", "p. 3)", "etc.", "“Go.”", "he", "said.", "wait…"]), max_size=12))
def test_no_sentence_begins_in_lower_case(model, words):
    text = " ".join(words)
    assert all(a == 0 or not text[a].islower() for a, _ in se.sentences(text, model))


def test_neighbouring_tags_decide(trained):
    """Somewhere the best sequence isn't what each open character says for itself."""
    model, differ = trained[0], 0
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        for _, end, fixed, marker in se.blocks(text or ""):
            found = [] if fixed else se.places(text[marker:end])
            differ += sum(y != (model.score(p) > 0) for y, p in zip(model.tags(found), found, strict=True))
    assert differ > 0


@pytest.mark.parametrize("part", ["(This is one.) ", "( ", 'He said "yes. ', "A.", "“Yes.” 他说。", "x" * 50 + ". Y "])
def test_time_is_linear(model, part):
    def took(n):
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            se.sentences(part * n, model)
            best = min(best, time.process_time() - began)
        return best

    small = took(10_000)
    assert small < 2.5
    assert took(20_000) < 4 * max(small, 0.05)


def test_long_tokens_and_sentences_count_whole(model):
    long = "w" * 300
    text = f"It names {long}. The next one says “{'very ' * 100}long.” He left."
    assert [text[a:b] for a, b in se.sentences(text, model)][0] == f"It names {long}."


def test_a_model_can_be_stored(model):
    again = se.Model.from_json(model.to_json())
    text = " ".join(PARTS)
    assert se.sentences(text, again) == se.sentences(text, model)


def test_blanks_may_be_missing(model):
    text = "The page is blank.Every cell was read.版本已保存。Done"
    assert [text[a:b] for a, b in se.sentences(text, model)] == ["The page is blank.", "Every cell was read.", "版本已保存。", "Done"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.!? \n\r\t-#|`1。“”()ตก", max_size=80))
def test_sentences_part_the_text(model, text):
    at = 0
    for a, b in se.sentences(text, model):
        assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() and a < b
        at = b
    assert not text[at:].strip()


def test_viterbi_is_best(model):
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.uniform(-3, 3) for _ in range(rng.randint(1, 8))]
        gaps = [rng.randint(0, 6) for _ in scores]

        def value(tags):
            total, before = 0.0, 1
            for x, g, t in zip(scores, gaps, tags, strict=True):
                total += model.moves[g][before][t] + (x if t else 0)
                before = t
            return total

        best = max(value([(k >> i) & 1 for i in range(len(scores))]) for k in range(1 << len(scores)))
        assert value([int(t) for t in se.viterbi(scores, gaps, model.moves)]) == pytest.approx(best)


def test_wrapped_numbers_are_no_lists(model):
    text = "Reading stopped after page\n255. The heading has no number.\n\n1. One\n2. Two"
    assert [text[a:b] for a, b in se.sentences(text, model)] == ["Reading stopped after page\n255.", "The heading has no number.", "1. One", "2. Two"]


def test_frame(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t", 1), (4, "One. Two.", 1), (4, "One. Two.", 1), (5, "x" * 60000, 1), (None, "A.", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int")
    got = sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in se.split_sentences(df, se.fit(df)).collect())
    assert got == [(0, 0, 2), (4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9), (5, 0, 60000)]
    assert se.fit(df, sample_chars=5).habits.keys() == {"a"}  # texts over the bound are left out whole
    empty = df.limit(0)
    assert se.split_sentences(empty, se.fit(empty)).count() == 0
