"""Building blocks of the comparison SQL: normal forms and tokens, where the engine has no function for them."""

from __future__ import annotations

import unicodedata

_RANGES = (range(0xA0, 0x100), range(0x0E00, 0x0F00), range(0x2000, 0x2070), range(0x2F00, 0x2FE0), range(0xFB00, 0xFB07), range(0xFF00, 0xFFF0))


def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    one, other, many = "", "", []
    for r in _RANGES:
        for cp in r:
            ch = chr(cp)
            to = unicodedata.normalize("NFKC", ch)
            if to != unicodedata.normalize("NFC", ch):
                if len(to) == 1:
                    one, other = one + ch, other + to
                else:
                    many.append((ch, to))
    return one, other, many


def nfkc(x: str) -> str:
    """SQL for NFKC of ``x`` on the ranges in use."""
    one, other, many = _tables()
    one, other = one.replace("'", "''"), other.replace("'", "''")
    out = f"translate({x}, '{one}', '{other}')"
    for ch, to in many:
        out = f"replace({out}, '{ch}', '{to}')"
    return f"nfc_normalize({out})"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def normal(x: str) -> str:
    return f"regexp_replace({fold(nfkc(x))}, '^[\\s\\v\x1c-\x1f\x85]+|[\\s\\v\x1c-\x1f\x85]+$', '', 'g')"


def tokens(x: str, indexing: bool = True) -> str:
    """SQL for the list of search tokens of ``x``."""
    spread = f"regexp_replace({nfkc(x)}, '([㐀-鿿]+)', ' \\1 ', 'g')"
    runs = f"regexp_extract_all({spread}, '[㐀-鿿]+|[\\p{{L}}\\p{{N}}]+(?:[_.:/+\\-][\\p{{L}}\\p{{N}}]+)*')"
    bigrams = "list_transform(range(1, length(r)::bigint), lambda i: substr(r, i, 2))"
    singles = "string_split(r, '')" if indexing else "case when length(r) = 1 then [r] else [] end"
    f = fold("r")
    plural = f"case when length({f}) > 3 and {f} like '%s' and not regexp_matches({f}, '(ss|us|is)$') then [{f}, left({f}, -1)] else [{f}] end"
    han = f"list_concat(list_concat([r], {bigrams}), {singles})"
    return f"flatten(list_transform({runs}, lambda r: case when regexp_matches(r, '^[㐀-鿿]') then {han} else {plural} end))"


#: White space of Unicode, for regular expressions.
SPACE = "[\\s\\v\x1c-\x1f\x85   -     　]"

#: lines(doc_id, line_no, line) of the documents.
LINES = """lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1)::int as line_no from (
    select doc_id, case when text = '' then [] when p[-1] = '' then p[:-2] else p end as l from (
      select doc_id, text, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]') as p from documents where text is not null) a) b)"""


def clauses(x: str) -> str:
    """SQL for the list of (start, end, clause) of a line ``x``."""
    marked = f"regexp_replace(regexp_replace({x}, '([。！？]+)', '\\1' || chr(57344), 'g'), '([.!?]+)({SPACE}|$|' || chr(57344) || ')', '\\1' || chr(57344) || '\\2', 'g')"
    return f"string_split({marked}, chr(57344))"
