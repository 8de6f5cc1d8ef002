"""Sheets as Markdown tables or records. CONV-10 to 18, and reading CSV and XLSX."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

from .text import trim

FORMATS = ("compact", "table", "records")
MAX_ROWS = 1_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(row, width: int) -> list[str]:
    return [trim(str(row[i])) if i < len(row) and row[i] is not None else "" for i in range(width)]


def _escape(cell: str) -> str:
    return re.sub(r"\r?\n", " ", cell.replace("|", "\\|"))


def sheet_lines(rows: list[list], style: str = "compact", max_rows: int = MAX_ROWS) -> list[str]:
    """The lines of one sheet: the first row that isn't blank names the columns, blank rows are skipped."""
    rows = [r for r in rows if any(c is not None and trim(str(c)) for c in r)]
    if not rows:
        return []
    data = rows[1:]
    shown = data[:max_rows]
    width = max([len(rows[0]), *map(len, shown)])
    heads = [h.replace("|", "\\|") or f"Col_{i}" for i, h in enumerate(_cells(rows[0], width), 1)]
    if style == "records":
        pairs = ([f"**{h}**: {c}" for h, c in zip(heads, _cells(r, width)) if c] for r in shown)
        out = [f"- [Ligne {i}] {' | '.join(p)}" for i, p in enumerate(pairs, 1) if p]
    else:
        row = (lambda cells: f"|{'|'.join(cells)}|") if style == "compact" else (lambda cells: f"| {' | '.join(cells)} |")
        out = [row(heads), row(["---"] * width), *(row(list(map(_escape, _cells(r, width)))) for r in shown)]
    out.append("\n")
    if len(data) > max_rows:
        out.append(f"> ⚠️ *Table tronquée: {len(data) - max_rows} lignes supplémentaires omises pour optimiser les tokens LLM.*\n")
    return out


def to_markdown(sheets: list[tuple[str, list[list]]], style: str = "compact", max_rows: int = MAX_ROWS) -> str:
    """Sheets (name, rows) one below the other, each under a heading if there are several."""
    out: list[str] = []
    for name, rows in sheets:
        if rows:
            out += [f"## Feuille: {name}\n"] if len(sheets) > 1 else []
            out += sheet_lines(rows, style, max_rows)
    return trim("\n".join(out))


def read_csv(content: bytes) -> list[tuple[str, list[list]]]:
    text = content.decode("utf-8-sig", "replace")
    head = text.partition("\n")[0]
    mark = max(",;\t", key=lambda c: (head.count(c), c == ","))
    return [("Sheet1", list(csv.reader(io.StringIO(text), delimiter=mark)))]


def _shown(value: str, kind: str | None, shared: list[str]) -> str | None:
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in ("str", "e"):
        return value
    try:
        number = float(value)
    except ValueError:
        return value
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def read_xlsx(content: bytes) -> list[tuple[str, list[list]]]:
    """Values of the sheets of a workbook; numbers as they print, no number formats."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)]
        root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        rows: list[list] = []
        for row in root.iter(f"{_MAIN}row"):
            at = int(row.get("r") or len(rows) + 1)
            rows += [[] for _ in range(at - 1 - len(rows))]
            cells: list = []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]+", c.get("r") or "")
                column = len(cells)
                if letters:
                    column = 0
                    for x in letters[0]:
                        column = column * 26 + ord(x) - 64
                    column -= 1
                cells += [None] * (column - len(cells))
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                else:
                    value = c.find(f"{_MAIN}v")
                    cells.append(None if value is None or value.text is None else _shown(value.text, c.get("t"), shared))
            rows.append(cells)
        out.append((sheet.get("name") or "Sheet", rows))
    return out
