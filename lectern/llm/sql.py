"""Comparison SQL for the queries that SQL can say on the test tables."""

from __future__ import annotations

import unicodedata

from lectern.plans import sqltext as sq

# Letters that look like a Latin one, by their Unicode names, as pairs "letter = Latin letter". A
# table of its own, so that a wrong or missing entry of the operator's table shows.
TWINS = """
А=A В=B Е=E Ѕ=S І=I Ј=J К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ү=Y Ԍ=G Ԛ=Q Ԝ=W
а=a е=e ѕ=s і=i ј=j о=o р=p с=c у=y х=x һ=h ԁ=d ԛ=q ԝ=w ҽ=e
Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ϲ=c ϳ=j
Ս=U Օ=O օ=o ս=u ո=n հ=h ց=g ɑ=a ɡ=g
"""

_COUNTED = f"""with t as (select {sq.normal('term')} as term, built_at, unnest(postings) as p from index_shards where term is not null),
o as (select term, p.entry_no as record, coalesce(p.field, '') as field, greatest(coalesce(p.n, 1), 0) as n, built_at from t where term <> '' and p.entry_no is not null),
l as (select *, row_number() over (partition by term, record, field order by built_at desc nulls last, n desc) as k from o),
c as (select term, sum(n)::bigint as frequency, count(distinct record) as n_records from l where k = 1 group by 1), a as (select count(distinct record) as every from l),
m as (select term, frequency, n_records, case when n_records < 3 then 'rare' when n_records > 0.1 * every then 'common' end as mark from c, a)"""


def _look(x: str) -> str:
    """Letters, digits, marks and blanks of one width, signs that can't be seen left out, look-alikes as Latin."""
    one, other, many = "", "", []
    for cp in (*range(0xA0, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)):
        ch = chr(cp)
        kind, to = unicodedata.category(ch), unicodedata.normalize("NFKC", ch)
        how = unicodedata.decomposition(ch).split(" ")[0]
        if kind == "Zs":
            one, other = one + ch, other + " "
        elif how in ("<wide>", "<narrow>") and kind[0] in "LNM" or 0x2E80 <= cp < 0x2FE0 and how:
            one, other = one + ch, other + to
        elif 0xFB00 <= cp <= 0xFB06:
            many.append((ch, to))
    for a, _, b in (x.partition("=") for x in TWINS.split()):
        one, other = one + a, other + b
        for mark in map(chr, range(0x300, 0x340)):  # letters with an accent in both scripts
            own, latin = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
            if len(own) == len(latin) == 1:
                one, other = one + own, other + latin
    out = f"translate(regexp_replace({x}, '[­​-‏⁠-⁤﻿]', '', 'g'), '{one}', '{other}')"
    for ch, to in many:
        out = f"replace({out}, '{ch}', '{to}')"
    return f"nfc_normalize({out})"


SQL = {
    "p1_found": f"{_COUNTED} select term, mark from m where mark is not null",
    "p1_terms": f"{_COUNTED} select term, frequency, n_records, mark from m",
    "p5_found": f"""with u as (select distinct unit_id, text, {_look('text')} as form from units where text <> ''), e as (select distinct entry_id, body, {_look('body')} as form from index_entries where body <> '')
select distinct u.unit_id, e.entry_id from u join e on u.form = e.form and u.text <> e.body where trim(u.form) <> ''""",
}
