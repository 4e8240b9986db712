"""Text functions: normal forms, tokens, lines, clauses, snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends: those of Unicode, as text files are read (carriage return and line feed count once).
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: A clause ends after full-width marks, after . ! ? before white space or the end, after line feeds.
CLAUSE_END = r"(?U)(?<=[。！？])(?![。！？])|(?<=[.!?])(?=\s|$)|(?<=\n)(?!\n)"
# Han signs that have tokens of their own, signs that join the parts of a word, and endings in s
# that are no plural.
HAN = range(0x3400, 0xA000)
JOINERS = "_.:/+-"
NO_PLURAL = ("ss", "us", "is")


class _Classes(dict):
    """The class of each code point: h Han, a letter or digit, j joiner, - else. Looked up once per code point."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = found = "h" if code in HAN else "j" if ch in JOINERS else "a" if ch.isalnum() else "-"
        return found


CLASSES = _Classes()
#: Tokens as they show in the classes of a text.
SPAN = re.compile("h+|a+(?:ja+)*")


def normal(text: str) -> str:
    """NFKC, case folding, trimming."""
    return unicodedata.normalize("NFKC", text).casefold().strip()


def han_tokens(run: str, singles: bool) -> list[str]:
    """A run of Han signs, its pairs of neighbours, and single signs if asked for."""
    pairs = map("".join, zip(run, run[1:], strict=False))
    return [run, *pairs, *(run if singles else ())]


def word_forms(word: str) -> list[str]:
    """A word in lower case, and its singular where it looks like a plural."""
    word = word.casefold()
    plural = len(word) > 3 and word.endswith("s") and not word.endswith(NO_PLURAL)
    return [word, word[:-1]] if plural else [word]


def token_list(text: str, indexing: bool = True) -> list[str]:
    """Search tokens: Han runs with their bigrams (and single signs where an index is built or the run has
    one), other words with inner joiners; a plural word also counts as its singular.

    The text is translated to character classes first, and spans are found there."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    kinds = text.translate(CLASSES)
    found = []
    for a, b in (m.span() for m in SPAN.finditer(kinds)):
        found += han_tokens(text[a:b], indexing or b - a == 1) if kinds[a] == "h" else word_forms(text[a:b])
    return found


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """``normal`` as a column function; null stays null."""
    return pd.Series([normal(x) if isinstance(x, str) else None for x in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def index_tokens(texts: pd.Series) -> pd.Series:
    """Tokens of a text to be indexed; none for null."""
    return pd.Series([token_list(x) if isinstance(x, str) else [] for x in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def query_tokens(texts: pd.Series) -> pd.Series:
    """Tokens of a query."""
    return pd.Series([token_list(x, False) if isinstance(x, str) else [] for x in texts], dtype=object)


def lines(text: Column) -> Column:
    """Lines of a text; a line end at the end of the text starts no further line."""
    parts = F.split(text, LINE_END, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def clauses(text: Column, indivisible: Column | None = None) -> Column:
    """Clauses of a text as an array of (start, end, text); blank ones are left out, offsets count them.
    An indivisible text is one clause."""
    parts = F.split(text, CLAUSE_END, -1)
    if indivisible is not None:
        parts = F.when(indivisible, F.array(text)).otherwise(parts)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    kept = lambda acc, x: F.when(x.rlike(r"(?U)\S"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), x.alias("text"))))).otherwise(acc["out"])
    return F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), kept(acc, x).alias("out")), lambda acc: acc["out"])


def snippet(text: Column, size: int = 500) -> list[Column]:
    """The first characters of a text, and whether there are more."""
    return [F.substring(text, 1, size).alias("snippet"), (F.length(text) > size).alias("snippet_truncated")]


def text_slice(text: Column, offset: Column, size: int) -> list[Column]:
    """A window of a text: what it shows, the length of all, where the next window starts (null at the end).
    An offset beyond the text is an error."""
    total = F.length(text)
    shown = F.when(offset > total, F.raise_error(F.lit("offset beyond the text"))).otherwise(F.substring(text, offset + 1, F.lit(size)))
    ends = offset + size
    return [shown.alias("shown"), total.alias("total_chars"), F.when(ends < total, ends).alias("next_text_offset")]


def content_id(prefix: str, content: Column) -> Column:
    """An id from content: a letter and 24 hexadecimal digits of its SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(content, 256), 1, 24))


def canonical(*fields: tuple[str, Column]) -> Column:
    """Canonical JSON: keys in order, nothing between, nulls kept."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields)]), {"ignoreNullFields": "false"})


def file_kind(name: Column) -> Column:
    """The kind of a file by its suffix."""
    # Suffixes and kinds.
    known = {"docx": "docx", "pdf": "pdf", "xlsx": "xlsx", "vsdx": "vsdx", "txt": "text", "text": "text", "log": "text", "md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "csv", "emf": "emf", "wmf": "emf", "svg": "svg", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "tif": "image", "tiff": "image", "webp": "image"}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))), F.lit("unsupported"))
