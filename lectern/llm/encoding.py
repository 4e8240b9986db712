"""Text decoded with the wrong encoding: found, and restored where possible.

Near twins are texts (whole ones and pairs of neighbouring words) that are equal once what isn't ASCII
is stripped. Each variant of such a group is joined with the most frequent one, the two are aligned at
their ASCII characters, and the stretches between give a table of mappings: what stands for what, and how
many pairs of twins say so. Mappings are explained by transformations (the encoding that a text had and the
one that it was read with); those that explain several mappings are learned, and extend the table to the
characters that no twin has. A mapping that none explains isn't used: twins also differ in what isn't garbled.
The transformations are then applied to all texts, also those without a twin:

- a text that was UTF-8 holds, in the bytes of the encoding it was read with, sequences that are valid
  UTF-8 and give characters that the collection knows; these are undone, until none is left;
- other encodings leave no such sign; there a word is taken as garbled if undoing a transformation gives a
  word more frequent in the collection than itself, and a whole text if all it gives is usual in the
  collection (bytes of one character may be ASCII and stand between words);
- replacement characters are mapped to an unknown sign: they show that a text was read wrongly.

Groups of twins are aggregated to (key, variant, count) and joined with one row per key, so a frequent
key costs as many rows as it has variants, never their pairs. Words and evidence refer to texts by a digest.
What is broadcast is bounded: transformations (fewer than the pairs of ``ENCODINGS``) and the characters in
use.

Cases: null and empty texts aren't found; repeated rows are found once; an empty table gives an empty
result; texts are processed whole.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

# The encodings considered.
ONE_BYTE = ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "cp1250", "cp1253", "cp1254", "mac-cyrillic")
MORE_BYTES = ("gb18030", "cp932", "big5", "euc-kr", "euc-jp")
ENCODINGS = ("utf-8", *ONE_BYTE, *MORE_BYTES)
LOST = "�"
STRETCH = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f])+")
ASCII = re.compile(r"[\x00-\x7f]+")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character of a one-byte encoding; bytes without a character stand for themselves."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if encoding == "cp1252":  # readers of Latin-1 differ in whether these bytes are signs or controls
        for b in range(0x80, 0xA0):
            out[chr(b)] = b
    return out


def to_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that gave ``text`` when read in an encoding; None if nothing could."""
    if read_as in ONE_BYTE:
        of = _bytes_of(read_as)
        try:
            return bytes([of[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(read_as)
    except UnicodeEncodeError:
        return None


def undo(text: str, was: str, read_as: str) -> str | None:
    """What ``text`` was, if it was encoded in ``was`` and read in ``read_as``; None if it can't be."""
    raw = to_bytes(text, read_as)
    if raw is None:
        return None
    try:
        out = raw.decode(was)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


def stripped(text: str) -> str:
    return STRETCH.sub("", text)


def weight(stretch: str) -> int:
    """Bytes that a stretch takes in encodings of one or two bytes."""
    return sum(2 if ord(c) >= 0x2E80 else 1 for c in stretch)


def twin_keys(text: str) -> Iterator[tuple[str, str]]:
    """(key, variant): the text stripped of what isn't ASCII, and the text itself; digits don't matter.
    Once for the whole text (with the size of each stretch), and for each word with a neighbour."""
    whole = re.sub(r"[0-9]+", "#", text)
    if sum(map(len, re.findall(r"[A-Za-z]+", whole))) >= 3:  # else there is nothing to align at
        yield "=" + STRETCH.sub(lambda m: f"<{weight(m.group())}>", whole), whole
    words = WORD.findall(whole)
    for i, w in enumerate(words):
        if w.isascii():
            continue
        own = stripped(w)
        for side, other in (("<", words[i - 1] if i else ""), (">", words[i + 1] if i + 1 < len(words) else "")):
            beside = stripped(other)
            if len(own) + len(beside) >= 4 and (own or len(beside) >= 5):
                yield f"{side}{own} {beside}", w


def align(one: str, two: str) -> list[tuple[str, str]]:
    """Pairs of stretches at the same place between equal ASCII characters."""
    a, b = stripped(one), stripped(two)
    if a != b:
        return []

    def gaps(s: str) -> list[str]:
        out = [""]
        for c in s:
            if c < "\x80":
                out.append("")
            else:
                out[-1] += c
        return out

    return [(x, y) for x, y in zip(gaps(one), gaps(two), strict=True) if x != y and x and y]


def sound(text: str) -> bool:
    """Whether no part of a text looks like UTF-8 read in a Western encoding."""
    return all(not raw or not _valid(raw) for m in STRETCH.findall(text) for read_as in ("latin-1", "cp1252", "mac-roman", "cp437") for raw in [to_bytes(m, read_as)])


def explain(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The transformations that turn ``clean`` into ``garbled``."""
    return [(was, read_as) for was in ENCODINGS for read_as in ENCODINGS if was != read_as and read_as != "utf-8" and undo(garbled, was, read_as) == clean]


def _spell(batch: pa.RecordBatch, rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


S = pa.string()


def twins(texts: DataFrame) -> DataFrame:
    """(variant, usual, rarer): variants of a stripped text, each with the most frequent one of its key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for t in b.column(0).to_pylist() for x in set(twin_keys(t))]
            yield _spell(b, rows, [("key", S), ("variant", S)])

    found = texts.mapInArrow(keys, "key string, variant string").groupBy("key", "variant").agg(F.count("*").alias("n"))
    found = materialize(found, "twins")
    usual = found.groupBy("key").agg(F.max(F.struct("n", "variant")).alias("top"), F.count("*").alias("variants")).where("variants > 1")
    joined = found.join(usual.select("key", F.col("top.n").alias("most"), F.col("top.variant").alias("usual")), "key")
    return joined.where(F.col("variant") != F.col("usual")).groupBy("variant", "usual").agg(F.bool_or(F.col("n") < F.col("most")).alias("rarer"))


def mappings(texts: DataFrame) -> DataFrame:
    """(garbled, clean, rarer, n) of aligned stretches of twins: how many pairs of twins show them, and whether
    the garbled one is the rarer in one of them."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, u, rarer in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs = align(v, u)
                if not pairs:
                    continue
                if sound(u):
                    rows += [(x, y, rarer) for x, y in set(pairs) if LOST not in x]
                elif sound(v):  # the garbled one may be the usual one; what was UTF-8 shows that itself
                    rows += [(y, x, False) for x, y in set(pairs) if LOST not in y]
            yield _spell(b, rows, [("garbled", S), ("clean", S), ("rarer", pa.bool_())])

    # pairs are spread evenly, whatever their key
    pairs = twins(texts).repartition(texts.sparkSession.sparkContext.defaultParallelism, "variant")
    return pairs.mapInArrow(infer, "garbled string, clean string, rarer boolean").groupBy("garbled", "clean").agg(F.bool_or("rarer").alias("rarer"), F.count("*").alias("n"))


def learn(table: DataFrame, least: int = 3) -> list[tuple[str, str]]:
    """Transformations that explain at least ``least`` different mappings, most first.

    A mapping that several transformations explain counts for each; one whose mappings another with more
    support explains as well adds nothing and is left out."""

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y, rarer in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by = sorted(f"{was}|{read_as}" for was, read_as in explain(x, y) if rarer or was == "utf-8")
                if by:
                    rows.append((by,))
            yield _spell(b, rows, [("by", pa.list_(S))])

    # which sets of transformations explain a mapping, and how many mappings each set has: bounded by ENCODINGS
    sets = table.select("garbled", "clean", "rarer").mapInArrow(explained, "`by` array<string>").groupBy("by").agg(F.count("*").alias("n"))
    left = {tuple(r["by"]): r["n"] for r in sets.collect()}
    return [(a, b) for x in chosen(left, least) for a, _, b in [x.partition("|")]]


def chosen(left: dict[tuple[str, ...], int], least: int) -> list[str]:
    """The fewest transformations that explain what sets of them explain, each with ``least`` cases no other has."""
    picked: list[str] = []
    order = {f"{a}|{b}": i for i, (a, b) in enumerate((a, b) for a in ENCODINGS for b in ENCODINGS)}
    while left:
        votes: dict[str, int] = {}
        for by, n in left.items():
            for x in by:
                votes[x] = votes.get(x, 0) + n
        best = min(votes, key=lambda x: (-votes[x], order[x]))
        if votes[best] < least:
            break
        picked.append(best)
        left = {by: n for by, n in left.items() if best not in by}
    return picked


#: Sequences of more than one byte as UTF-8 forms them.
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _valid(raw: bytes) -> list[tuple[int, int]]:
    """Places of valid UTF-8 sequences of more than one byte."""

    def sound_(part: bytes) -> bool:
        try:
            return bool(part.decode("utf-8"))
        except UnicodeDecodeError:
            return False

    return [m.span() for m in SEQUENCE.finditer(raw) if sound_(m.group())]


@lru_cache(maxsize=None)
def _lead(read_as: str) -> re.Pattern:
    """What a sequence of UTF-8 begins with, as read in a one-byte encoding: a lead and a further byte."""
    of = _bytes_of(read_as)
    kind = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in of.items() if lo <= b <= hi) + "]"
    return re.compile(kind(0xC2, 0xF4) + kind(0x80, 0xBF))


def undo_utf8(text: str, read_as: str, known: set[str]) -> str:
    """``text`` with each sequence undone that was UTF-8 and read in ``read_as``, where the result is made
    of characters in use."""
    if read_as in ONE_BYTE:
        if not _lead(read_as).search(text):
            return text
        of = _bytes_of(read_as)

        def fix(m: re.Match) -> str:
            s = m.group()
            out, i = [], 0
            while i < len(s):
                b = of.get(s[i], 0)
                size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
                part = s[i : i + size]
                if size and len(part) == size:
                    try:
                        ch = bytes([of.get(c, 0) for c in part]).decode("utf-8")
                    except UnicodeDecodeError:
                        ch = ""
                    if len(ch) == 1 and ch in known:
                        out.append(ch)
                        i += size
                        continue
                out.append(s[i])
                i += 1
            return "".join(out)

        return STRETCH.sub(fix, text)

    def fix_wide(m: re.Match) -> str:
        s = m.group()
        raw = to_bytes(s, read_as)
        if not raw:
            return s
        places = _valid(raw)
        high = sum(b > 0x7F for b in raw)
        covered = sum(b - a for a, b in places)
        if not places or covered < high - 2 or covered < 0.8 * high:
            return s
        out = raw.decode("utf-8", errors="replace")
        return out if all(c in known for c in out if c > "\x7f" and c != LOST) else s

    return re.sub(r"[^\x00-\x7f�]+", fix_wide, text)


def undo_all(text: str, readings: list[str], known: set[str]) -> str:
    """Undo learned readings of UTF-8, one over the other, until none is left (each makes the text take fewer bytes).
    The reading that undoes most goes first."""
    while True:
        best = text
        for read_as in readings:
            out = undo_utf8(text, read_as, known)
            if out != text and (best == text or len(STRETCH.sub(lambda m: "x" * len(m.group()), out)) < len(best)):
                best = out
        if len(best.encode("utf-8", "replace")) >= len(text.encode("utf-8", "replace")):
            return text
        text = best


def characters(texts: DataFrame, least: int = 2) -> dict[str, int]:
    """Characters beyond ASCII that at least ``least`` texts hold, and how many do; bounded by Unicode. The
    empty string has the number of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                for c in set("".join(STRETCH.findall(t))):
                    counts[c] = counts.get(c, 0) + 1
            yield _spell(b, list(counts.items()), [("ch", S), ("n", pa.int64())])

    rows = texts.select("text").mapInArrow(run, "ch string, n bigint").groupBy("ch").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r["ch"]: r["n"] for r in rows.collect()} | {"": texts.count()}


def beyond(text: str) -> set[str]:
    """The different characters beyond ASCII of a text."""
    return {c for c in text if c > "\x7f"}


def signs(word: str) -> int:
    """Characters beyond ASCII."""
    return len(word) - len(stripped(word))


def words_of(text: str) -> list[str]:
    """Words with characters beyond ASCII, and longer stretches of these within words that mix scripts."""
    return sorted({w for w in WORD.findall(text) if not w.isascii()} | {x for x in STRETCH.findall(text) if len(x) >= 3})


@lru_cache(maxsize=None)
def _charmap(encoding: str) -> dict[int, int]:
    return {ord(c): b for c, b in _bytes_of(encoding).items()}


#: What stands for a character that an encoding lacks; no word has it.
NONE = "\x01"
codecs.register_error("lectern-none", lambda e: (NONE.encode() if isinstance(e, UnicodeEncodeError) else LOST, e.end))


def undo_each(words: list[str], was: list[str], read_as: str) -> Iterator[tuple[int, str, str]]:
    """(index, encoding, what the word was) for words, if they were encoded in one of ``was`` and read in
    ``read_as``. All words go through a codec at once."""
    joined = "\n".join(words)
    raw = codecs.charmap_encode(joined, "lectern-none", _charmap(read_as))[0] if read_as in ONE_BYTE else joined.encode(read_as, "lectern-none")
    lines = raw.split(b"\n")
    if len(lines) != len(words):  # a text with a line break, or a codec that takes one for part of a character
        lines = [to_bytes(w, read_as) or NONE.encode() for w in words]
    good = [i for i, x in enumerate(lines) if NONE.encode() not in x]
    if not good:
        return
    raw = b"\n".join(lines[i] for i in good)
    for name in was:
        outs = raw.decode(name, "replace").split("\n")
        if len(outs) != len(good) or len(raw.split(b"\n")) != len(good):
            outs = [lines[i].decode(name, "replace") for i in good]
        for i, out in zip(good, outs, strict=True):
            if out != words[i] and LOST not in out and not out.isascii():
                yield i, name, out


def whole_texts(texts: list[str], applied: list[tuple[str, str]], counts: dict[str, int], least: int) -> dict[int, tuple[str, int]]:
    """What texts were, where a transformation gives one as a whole, by index, and how many of its characters
    that changes.

    The bytes of one character may be ASCII, so what has changed isn't words. All signs that come out have
    to be known, and likelier than those they come from: together if the bytes have to be valid, each ten
    times if any bytes are. ``counts`` has the number of all texts under the empty string."""
    usual = lambda cs: sum(math.log(counts.get(c, 1) / (counts[""] + 1)) for c in cs)
    top = max((n for c, n in counts.items() if c), default=0)
    own = [[c for c in t if c > "\x7f"] for t in texts]
    rare = [all(10 * counts.get(c, 1) <= top for c in cs) for cs in own]  # others can't come from rarer signs
    worth = [usual(cs) for cs in own]
    best: dict[int, tuple[str, int, float]] = {}
    by_reading: dict[str, list[str]] = {}
    for was, read_as in applied:
        by_reading.setdefault(read_as, []).append(was)
    for read_as, names in by_reading.items():
        for valid in (True, False):
            some = [x for x in names if (x in MORE_BYTES) == valid]
            asked = [i for i, cs in enumerate(own) if cs and (valid or rare[i])]
            for j, _, out in undo_each([texts[i] for i in asked], some, read_as) if some and asked else ():
                i = asked[j]
                new = [c for c in out if c > "\x7f"]
                used = len(texts[i]) - len(out) + len(new)
                if used < least or not all(c in counts for c in new):
                    continue
                if valid:
                    if usual(new) <= worth[i]:
                        continue
                elif len(new) != len(own[i]) or not all(counts[y] >= 10 * counts.get(x, 1) for x, y in zip(own[i], new, strict=True)):
                    continue
                if i not in best or usual(new) > best[i][2]:
                    best[i] = out, used, usual(new)
    return {i: x[:2] for i, x in best.items()}


def garbled_words(texts: DataFrame, learned: list[tuple[str, str]], counts: dict[str, int], least: int = 3) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(key, votes, changed) of texts (key, text) with words that a transformation other than from UTF-8
    explains, and the transformations that are applied.

    A word counts as garbled if what it was is more frequent. A transformation is applied if it was
    learned from twins, or if it explains as many different words as learning asks for, in texts where it
    explains three signs beyond ASCII or more. One or two signs prove nothing alone: a text needs three, in
    one word or in several, that one applied transformation explains. Only characters in use come out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, w) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in words_of(t)]
            yield _spell(b, rows, [("key", pa.binary()), ("word", S)])

    shared = texts.sparkSession.sparkContext.broadcast(frozenset(counts))

    def undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            own, many = b.column(0).to_pylist(), b.column(1).to_pylist()
            outs: dict[tuple[int, str], list[str]] = {}
            for read_as in ENCODINGS[1:] if own else ():
                for i, was, out in undo_each(own, [x for x in ENCODINGS[1:] if x != read_as], read_as):
                    outs.setdefault((i, out), []).append(f"{was}|{read_as}")
            rows = [(own[i], many[i], signs(own[i]), out, by) for (i, out), by in outs.items() if known.issuperset(beyond(out))]
            yield _spell(b, rows, [("word", S), ("n", pa.int64()), ("size", pa.int64()), ("was", S), ("by", pa.list_(S))])

    of_text = materialize(texts.mapInArrow(words, "key binary, word string"), "words")
    count = materialize(of_text.groupBy("word").agg(F.count("*").alias("n")), "counts")
    # few rows, but each is tried with every pair of encodings
    guesses = count.repartition(texts.sparkSession.sparkContext.defaultParallelism, "word").mapInArrow(undone, "word string, n bigint, size bigint, was string, `by` array<string>")
    better = guesses.join(count.select(F.col("word").alias("was"), F.col("n").alias("was_n")), "was").where((F.col("was_n") > F.col("n")) & (F.col("was_n") > 1))
    better = materialize(better, "undone")
    # signs of a text that each transformation explains, over all its words
    explained = of_text.join(better.select("word", "size", "was", F.explode("by").alias("x")), "word")
    evidence = explained.groupBy("key", "x").agg(F.sum("size").alias("size"), F.collect_list(F.struct("word", "was")).alias("words")).where("size >= 3")
    evidence = materialize(evidence, "evidence")
    # sets of transformations that explain a word: bounded by ENCODINGS
    sets = evidence.select("x", F.inline("words")).groupBy("word", "was").agg(F.array_sort(F.collect_set("x")).alias("by")).groupBy("by").agg(F.count("*").alias("n"))
    left = {tuple(r["by"]): r["n"] for r in sets.collect()}
    applied = {f"{a}|{b}" for a, b in learned} | set(chosen(left, least))
    best = better.where(F.arrays_overlap("by", F.array(*[F.lit(x) for x in sorted(applied)]))).groupBy("word").agg(F.max("size").alias("size"), F.max_by("by", F.struct("was_n", "was")).alias("by"))
    hit = of_text.join(best, "word").groupBy("key").agg(F.collect_list(F.struct("size", "by")).alias("votes"), F.sum("size").alias("changed"))
    whole = evidence.where(F.col("x").isin(sorted(applied))).select("key").distinct()
    return hit.join(whole, "key", "left_semi").select("key", "votes", "changed"), [(a, b) for x in sorted(applied) for a, _, b in [x.partition("|")]]


def undo_words(text: str, votes: list[dict]) -> str:
    """``text`` with every word undone by the transformation that explains most of its garbled words."""
    weights: dict[str, int] = {}
    for v in votes:
        for x in v["by"]:
            weights[x] = weights.get(x, 0) + v["size"]
    was, _, read_as = min(weights, key=lambda x: (-weights[x], x)).partition("|")

    def part(m: re.Match) -> str:
        w = m.group()
        return w if w.isascii() else undo(w, was, read_as) or STRETCH.sub(lambda x: undo(x.group(), was, read_as) or x.group(), w)

    return WORD.sub(part, text)


def changed(text: str, out: str) -> int:
    """Characters beyond ASCII of ``text`` that ``out`` lacks."""
    kept = set(out)
    return sum(c > "\x7f" and c not in kept for c in text)


def garbled_texts(paragraphs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """(text, restored) of the distinct garbled texts; restored is null where signs are lost."""
    texts = paragraphs.select(F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")).distinct()
    texts = materialize(texts.select(F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("key"), "text"), "texts")
    table = materialize(mappings(texts.select("text")), "mappings")
    learned = learn(table, least)
    from_utf8 = [b for a, b in learned if a == "utf-8"]
    counts = characters(texts)
    by_word, applied = garbled_words(texts, [(a, b) for a, b in learned if a != "utf-8"], counts, least)
    by_word = materialize(by_word, "garbled")
    spark = paragraphs.sparkSession
    shared = spark.sparkContext.broadcast((from_utf8, counts, applied))
    schema = [("key", pa.binary()), ("restored", S), ("changed", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, known, pairs = shared.value
        for b in batches:
            rows, rest = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = undo_all(t, readings, known)
                if out != t or LOST in t:
                    most = 1_000_000 if 2 * changed(t, out) >= signs(t) else 0
                    rows.append((k, None if LOST in out else out, most + changed(t, out)))
                else:
                    rest.append((k, t))
            rows += [(rest[i][0], *found) for i, found in whole_texts([t for _, t in rest], pairs, known, least).items()]
            yield _spell(b, rows, schema)

    def run_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings, known, pairs = shared.value
        for b in batches:
            rows = []
            whole = whole_texts(b.column(1).to_pylist(), pairs, known, least)
            for i, (k, t, votes, n) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                found = whole.get(i)
                out = undo_all(found[0] if found else undo_words(t, votes), readings, known)
                rows.append((k, None if LOST in t or LOST in out else out, n + bool(found)))
            yield _spell(b, rows, schema)

    types = "key binary, restored string, changed bigint"
    found = texts.mapInArrow(run, types).unionByName(texts.join(by_word, "key").select("key", "text", "votes", "changed").mapInArrow(run_words, types))
    # of two explanations that from UTF-8 holds if it covers half of the text, else the one that covers more
    found = found.groupBy("key").agg(F.max_by("restored", F.struct("changed", "restored")).alias("restored"))
    return texts.join(found, "key").select("text", "restored")


def paragraphs_of(sources: DataFrame) -> DataFrame:
    """(source_id, para_id, text) of all paragraphs."""
    return sources.select("source_id", F.explode("structure.paragraphs").alias("p")).select("source_id", F.col("p.id").alias("para_id"), F.col("p.text").alias("text"))


def garbled_paragraphs(sources: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, para_id, text, restored) of garbled paragraphs, each once."""
    rows = materialize(paragraphs_of(sources).where(F.length("text") > 0).distinct(), "paragraphs")
    return rows.join(garbled_texts(rows, least=least), "text").select("source_id", "para_id", "text", "restored")
