"""One consistent form for text that looks the same.

Text is exploded to positioned code points, these are joined with broadcast mapping tables
(decomposition, invisible signs, look-alike letters), combining marks are ordered by their class,
the sequence is recomposed, and strings are rebuilt. The tables are made from the Unicode data of
Python by rule and hold one entry per code point, so their size is bounded whatever the data; the
explode and the joins run inside Arrow batches as array operations, so nothing is shuffled.

What counts as the same look: width of letters, digits and spaces, composed or combining accents,
ligatures, radicals and letters of other scripts of the same shape, and signs that can't be seen.
Case, visible accents, digits and punctuation stay.

Look-alikes are first brought to Latin; a word that then still holds a letter only Cyrillic or Greek
has is given back to that script. A word without any such sign follows the majority of its text, if all
its letters are usual look-alikes of that script and the text has the word in no Latin spelling of another
case. As this depends on the Latin form alone, texts of the same look always get the same result.

Cases: null stays null, empty stays empty, a text of invisible signs alone becomes empty.
"""

from __future__ import annotations

import hashlib
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import materialize

# Letters of the same shape, each with its Latin one.
LOOK_ALIKE = {
    "CYRILLIC": dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝҽ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwe", strict=True)),
    "GREEK": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True)),
    "ARMENIAN": dict(zip("ՍՕօսոհց", "UOounhg", strict=True)),
    "LATIN": {"ɑ": "a", "ɡ": "g", "ı": "ı"},
}
#: Compatibility decompositions that keep the look (tags of the Unicode data).
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Format signs that are seen, and fillers that aren't though they count as letters or marks.
SEEN = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD}
UNSEEN = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10)}
JOINERS = (0x200C, 0x200D)
LATIN, CYRILLIC, GREEK, WEAK = 1, 2, 3, 4
#: Latin letters whose twin is usual in Cyrillic or Greek text. Other letters with a twin say
#: nothing beside a sure letter of the word, but make a word without one Latin.
USUAL = {"CYRILLIC": set("ABEKMHOPCTXYaeopcyx"), "GREEK": set("ABEZHIKMNOPTYXov")}


def _shape(cp: int) -> list[int]:
    """What a code point is mapped to, before look-alikes: fully decomposed, possibly nothing."""
    ch, kind = chr(cp), ud.category(chr(cp))
    if cp in UNSEEN or (kind == "Cf" and cp not in SEEN) or (kind == "Cc" and ch not in "\t\n\r"):
        return []
    if kind == "Zs":
        return [0x20]
    how = ud.decomposition(ch)
    if how.startswith("<"):
        tag = how.split(" ", 1)[0]
        ligature = 0xFB00 <= cp <= 0xFB17 or 0x2E80 <= cp <= 0x2FD5
        if not (ligature or (tag in SAME_LOOK and kind[0] in "LNM")):
            return [cp]
        return [y for x in how.split()[1:] for y in _shape(int(x, 16))]
    return [ord(x) for x in ud.normalize("NFD", ch)]


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Mapping tables by code point; made once per worker."""
    top = 0x110000
    flat: list[int] = []
    start, count = np.zeros(top, np.int32), np.ones(top, np.int8)
    one = np.arange(top, dtype=np.uint32)
    kind = np.zeros(top, np.int8)  # 1 letter or mark, 0 else
    ccc = np.zeros(top, np.uint8)
    script = np.zeros(top, np.int8)
    images = {ord(v) for s in ("CYRILLIC", "GREEK") for v in LOOK_ALIKE[s].values()}
    for cp in [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        to = _shape(cp)
        if to != [cp]:
            start[cp], count[cp] = len(flat), len(to)
            flat += to
            if len(to) == 1:
                one[cp] = to[0]
        ch = chr(cp)
        kind[cp] = ud.category(ch)[0] in "LM"
        ccc[cp] = ud.combining(ch)
        if cp < 0x2000 and ch.isalpha() and cp not in images:
            name = ud.name(ch, "")
            script[cp] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
    for cp in images:
        script[cp] = 0 if any(chr(cp) in held for held in USUAL.values()) else WEAK
    odd = {f"not {s}": np.zeros(top, bool) for s in USUAL}  # letters that make a word without a sure one Latin
    for s, held in USUAL.items():
        odd[f"not {s}"][[cp for cp in images if chr(cp) not in held]] = True
    like = np.arange(top, dtype=np.uint32)
    back = {s: np.arange(top, dtype=np.uint32) for s in ("CYRILLIC", "GREEK")}
    for s, pairs in LOOK_ALIKE.items():
        for a, b in pairs.items():
            like[ord(a)] = ord(b)
            script[ord(a)] = 0
            if s in back and back[s][ord(b)] == ord(b):
                back[s][ord(b)] = ord(a)
    return {"flat": np.array(flat, np.uint32), "start": start, "count": count, "one": one, "kind": kind, "ccc": ccc, "script": script, "like": like, **back, **odd}


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Code points that can join with one before them."""
    out = {chr(x) for x in range(0x1161, 0x11C3)}
    for cp in range(0x20000):
        parts = ud.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _bincount(groups: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups[mask], minlength=n)


def _spelt_elsewhere(out: np.ndarray, first: np.ndarray, text_of: np.ndarray, own: np.ndarray, guess: np.ndarray) -> None:
    """Make words Latin that show no script but stand in the same text in another case that is Latin."""
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(out))
    asked = np.flatnonzero((own == 0) & (guess > LATIN) & (end - begin > 1))
    held: dict[int, set[str]] = {}
    spell = lambda w: out[begin[w] : end[w]].tobytes().decode("utf-32-le", "surrogatepass").lower()
    for w in asked.tolist():
        i = int(text_of[w])
        if i not in held:
            lo, hi = np.searchsorted(text_of, [i, i + 1])
            held[i] = {spell(x) for x in (lo + np.flatnonzero(own[lo:hi] == LATIN)).tolist()}
        if held[i] and spell(w) in held[i]:
            guess[w] = LATIN


def consistent(texts: list[str]) -> list[str]:
    """The consistent form of each text of a batch."""
    if not texts:
        return []
    t = tables()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    # joiners stay where they change the look: after Arabic and Indic letters, and within emoji
    n = t["count"][cps].astype(np.int64)
    if len(cps) > 1:
        before = np.concatenate(([0], cps[:-1]))
        keep = np.isin(cps, JOINERS) & (((before >= 0x600) & (before < 0xE00)) | ((before >= 0x1F000) & (before < 0x20000)))
        n[keep] = 1
    total = int(n.sum())
    at = np.repeat(t["start"][cps].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(total)
    source = np.repeat(cps, n)
    out = t["one"][source]
    many = t["count"][source] > 1
    if many.any():
        out[many] = t["flat"][at[many]]
    owner = np.repeat(owner, n)
    out = t["like"][out]
    if not total:
        return [""] * len(texts)
    # words of letters and marks go back to the script that they show
    inside = t["kind"][out] == 1
    first = np.ones(total, bool)
    first[1:] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
    word = np.cumsum(first) - 1
    words = int(word[-1]) + 1
    script = t["script"][out]
    if ((script == CYRILLIC) | (script == GREEK)).any():
        has = {s: _bincount(word, script == s, words) > 0 for s in (LATIN, CYRILLIC, GREEK, WEAK)}
        own = np.where(has[LATIN], LATIN, np.where(has[CYRILLIC], CYRILLIC, np.where(has[GREEK], GREEK, np.where(has[WEAK], LATIN, 0))))
        text_of = owner[first]
        votes = np.stack([np.bincount(text_of[own == s], minlength=len(texts)) for s in (LATIN, CYRILLIC, GREEK)])
        usual = votes.argmax(axis=0) + 1
        guess = np.where(own == 0, usual[text_of], own)
        for s, name in ((CYRILLIC, "CYRILLIC"), (GREEK, "GREEK")):
            guess[(own == 0) & (guess == s) & (np.bincount(word, t[f"not {name}"][out], words) > 0)] = LATIN
        _spelt_elsewhere(out, first, text_of, own, guess)
        own = guess[word]
        for s, name in ((CYRILLIC, "CYRILLIC"), (GREEK, "GREEK")):
            pick = (own == s) & inside
            out[pick] = t[name][out[pick]]
    # marks by class within what follows a starter
    ccc = t["ccc"][out]
    if (ccc > 0).any():
        segment = np.cumsum((ccc == 0) | (np.concatenate(([1], owner[1:] != owner[:-1]))))
        order = np.lexsort((ccc, segment))
        out, owner = out[order], owner[order]
    whole = out.tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right").tolist()
    rebuilt, begin, seconds = [], 0, _seconds()
    for end in ends:
        s = whole[begin:end]
        begin = end
        rebuilt.append(s if s.isascii() or seconds.isdisjoint(s) else recompose(s))
    return rebuilt


@lru_cache(maxsize=200_000)
def _joined(a: str, b: str) -> str:
    """The one code point that a and b compose to, or an empty string."""
    both = ud.normalize("NFC", a + b)
    return both if len(both) == 1 else ""


def recompose(s: str) -> str:
    """Join starters with the marks after them, where Unicode has one sign for both and no mark of the
    same or a higher class stands between."""
    out: list[str] = []
    starter, last = -1, 0
    for ch in s:
        c = ud.combining(ch)
        near = starter == len(out) - 1
        if starter >= 0 and (near or (c and last < c)):
            both = _joined(out[starter], ch)
            if both:
                out[starter] = both
                continue
        if c == 0:
            starter, last = len(out), 0
        else:
            last = c
        out.append(ch)
    return "".join(out)


@F.pandas_udf(T.StringType())
def consistent_form(texts: pd.Series) -> pd.Series:
    """The consistent form as a column function; null stays null."""
    known = texts.notna().to_numpy()
    out = np.full(len(texts), None, dtype=object)
    out[known] = consistent(texts[known].tolist())
    return pd.Series(out, index=texts.index)


def with_form(df: DataFrame, text: str | Column = "text", name: str = "form") -> DataFrame:
    """``df`` with the consistent form of a text column."""
    return df.withColumn(name, consistent_form(F.col(text) if isinstance(text, str) else text))


def digest(text: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _digests(texts: DataFrame) -> DataFrame:
    """(text, form): digests of the distinct texts of a column and of their forms; texts without a form that
    can be seen are left out. Nothing but digests leaves the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()[:16]
        for b in batches:
            own = b.column(0).unique().to_pylist()
            pairs = [(short(t), short(f)) for t, f in zip(own, consistent(own), strict=True) if f.strip(" ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], names=["text", "form"])

    return texts.mapInArrow(run, "text binary, form binary").distinct()


def look_alike_pairs(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str) -> DataFrame:
    """Distinct (left_id, right_id) whose texts look the same but differ.

    Each side is reduced to its distinct texts and their forms, as digests; forms that both sides have are
    joined where the texts differ. Ids are attached last, so that every row made there is in the result: no
    pair of equal texts is ever built, however many rows share one. Null, empty and unseen texts are in no
    pair."""

    def ids(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        return df.where((F.length(text) > 0) & F.col(key).isNotNull()).select(F.col(key).alias(f"{name}_id"), F.col(text).alias("text"))

    a, b = ids(left, left_id, left_text, "a"), ids(right, right_id, right_text, "b")
    one, two = (_digests(x.select("text")).withColumnRenamed("text", f"{n}_text") for x, n in ((a, "a"), (b, "b")))
    unequal = materialize(one.join(two, "form").where(F.col("a_text") != F.col("b_text")).select("a_text", "b_text"), "unequal")
    a, b = a.select("a_id", digest(F.col("text")).alias("a_text")), b.select("b_id", digest(F.col("text")).alias("b_text"))
    return a.join(unequal, "a_text").join(b, "b_text").select(F.col("a_id").alias(left_id), F.col("b_id").alias(right_id)).distinct()
