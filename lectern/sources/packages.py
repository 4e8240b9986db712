"""Writers of small office packages: text documents, workbooks, diagrams, CSV.

They make the files that round trips through the readers need; what they write is the least that the
formats ask for. Members have a fixed time, so equal input gives equal bytes."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from lectern.sources.office import DIAGRAM, LINK, OBJECT, SHEET, WORD

ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
PIECE = re.compile(r"\S+\s*|\s+")
BASE = WORD.strip("{}"), LINK.strip("{}"), OBJECT.strip("{}")


def clean(text: str | None) -> str:
    """A text without what XML can't hold."""
    return ILLEGAL.sub("", text or "")


def pack(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def links(rows: list[tuple[str, str, bool]]) -> str:
    outside = ' TargetMode="External"'
    return "<Relationships>" + "".join(f'<Relationship Id={quoteattr(i)} Type="t/image" Target={quoteattr(t)}{outside if e else ""}/>' for i, t, e in rows) + "</Relationships>"


def run(text: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def text_document(paragraphs: list[dict], embedded: bytes | None = None) -> bytes:
    """A document of paragraphs (text, heading_level, kind): a run per word, headings by style and with a
    comment each, an image reference per link, and a table of kinds with merged cells."""
    body, comments, rels, media = [], [], [], {}
    for i, p in enumerate(paragraphs, 1):
        text, level = clean(p["text"]), p.get("heading_level")
        style = f'<w:pPr><w:pStyle w:val="H{level}"/></w:pPr>' if level else ""
        mark = f'<w:commentReference w:id="{i}"/>' if level else ""
        if level:
            comments.append(f'<w:comment w:id="{i}" w:author="reader"><w:p>{run(text)}</w:p></w:comment>')
        pictures = ""
        for target in re.findall(r"!\[[^\]]*\]\(([^)]+)\)", text):
            rid = f"r{len(rels) + 1}"
            outside = "://" in target
            rels.append((rid, target, outside))
            if not outside:
                media.setdefault(f"word/{target}", target.encode())
            pictures += f'<w:r><a:blip xmlns:a="a" r:embed="{rid}"/></w:r>'
        body.append(f"<w:p>{style}{''.join(run(x) for x in PIECE.findall(text))}{mark}{pictures}</w:p>")
    rows, before = [], None
    for p in paragraphs:
        merge = "<w:vMerge/>" if p["kind"] == before else '<w:vMerge w:val="restart"/>'
        before = p["kind"]
        rows.append(f'<w:tr><w:tc><w:tcPr>{merge}</w:tcPr><w:p>{run(clean(p["kind"]))}</w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p/></w:tc></w:tr>')
    if rows:
        body.append(f"<w:tbl>{''.join(rows)}</w:tbl>")
    space = f'xmlns:w="{BASE[0]}" xmlns:r="{BASE[1]}" xmlns:o="{BASE[2]}"'
    strike = "<w:rPr><w:strike/></w:rPr>"
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{n}"><w:basedOn w:val="{"Struck" if n == 1 else "Plain"}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr></w:style>' for n in range(1, 7))
    parts = {
        "word/document.xml": f"<w:document {space}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {space}><w:style w:type="paragraph" w:styleId="Plain"/><w:style w:type="paragraph" w:styleId="Struck">{strike}</w:style>{styles}</w:styles>',
        "word/comments.xml": f"<w:comments {space}>{''.join(comments)}</w:comments>",
        "word/_rels/document.xml.rels": links(rels),
        **media,
    }
    if embedded is not None:
        parts["word/embeddings/inner.docx"] = embedded
    return pack(parts)


def workbook(rows: list[list[str | None]], charts: int = 0) -> bytes:
    """A workbook of one sheet: the first column as shared strings, others inline; None is a formula without a
    stored result."""
    shared = [clean(r[0]) for r in rows]
    lines = []
    for n, r in enumerate(rows, 1):
        cells = [f'<c r="A{n}" t="s"><v>{n - 1}</v></c>']
        for column, v in zip("BCDEFGH", r[1:], strict=False):
            cells.append(f'<c r="{column}{n}"><f>A{n}</f></c>' if v is None else f'<c r="{column}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(clean(v))}</t></is></c>')
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')
    space = f'xmlns="{SHEET.strip("{}")}" xmlns:r="{BASE[1]}"'
    return pack(
        {
            "xl/workbook.xml": f'<workbook {space}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": links([("r1", "worksheets/sheet1.xml", False)]),
            "xl/sharedStrings.xml": f"<sst {space}>{''.join(f'<si><t xml:space={chr(34)}preserve{chr(34)}>{escape(s)}</t></si>' for s in shared)}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>",
            **{f"xl/charts/chart{i + 1}.xml": "<c/>" for i in range(charts)},
        }
    )


def diagram(texts: list[str | None]) -> bytes:
    """A diagram of nested shapes: each holds the next; neighbours are connected."""
    shapes = ""
    for n in range(len(texts), 0, -1):
        inner = f"<Shapes>{shapes}</Shapes>" if shapes else ""
        shapes = f'<Shape ID="{n}"><Text>{escape(clean(texts[n - 1]))}</Text>{inner}</Shape>'
    lines = "".join(f'<Connect FromSheet="{n}" ToSheet="{n + 1}"/>' for n in range(1, len(texts)))
    return pack({"visio/pages/page1.xml": f'<PageContents xmlns="{DIAGRAM.strip("{}")}"><Shapes>{shapes}</Shapes><Connects>{lines}</Connects></PageContents>'})


def csv_file(rows: list[list[str]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()
