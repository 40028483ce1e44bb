"""Workbooks (.xlsx) of plain sheets, by the published Office Open XML layout."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_PART = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _cell(row: int, k: int, value) -> str:
    at = f"{_column(k)}{row}"
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """The bytes of a workbook: name -> column names and rows."""
    out = io.BytesIO()
    names = [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] for n in sheets]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_PART}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_PART}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, (columns, rows) in enumerate(sheets.values(), 1):
            lines = (f'<row r="{r}">{"".join(_cell(r, i, v) for i, v in enumerate(row))}</row>' for r, row in enumerate([columns, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def read(data: bytes) -> dict[str, list[list]]:
    """Sheet name -> rows of cells, for workbooks that ``write`` makes."""
    ns, found = {"m": _MAIN}, {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns)]
        for k, name in enumerate(names, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iterfind("m:sheetData/m:row", ns):
                cells: dict[int, object] = {}
                for c in row.iterfind("m:c", ns):
                    letters = re.match("[A-Z]+", c.get("r"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    value = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")) if c.get("t") == "inlineStr" else c.find("m:v", ns).text
                    cells[at - 1] = value if c.get("t") == "inlineStr" else bool(int(value)) if c.get("t") == "b" else float(value)
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            found[name] = rows
    return found
