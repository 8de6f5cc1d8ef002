"""Format dispatch, and readers of the binary formats that need no library: DOCX, PDF (text streams), XLSX. SRC-01 to 12."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from html import escape
from xml.etree import ElementTree

from . import html, plain, sheets

#: Extensions and parts of MIME types by format, in order of the tests.
FORMATS = (
    ("doc", ("doc",), ()),
    ("docx", ("docx",), ("wordprocessingml",)),
    ("pdf", ("pdf",), ("pdf",)),
    ("sheet", ("xlsx", "xls", "csv"), ("spreadsheet", "csv")),
    ("html", ("html", "htm"), ("html",)),
    ("image", ("png", "jpg", "jpeg", "webp", "bmp", "tiff"), ("image/",)),
)
NO_DOC = "Le format Word 97-2003 (.doc) n'est pas supporté : enregistrez le document en .docx."
NO_TEXT = "Aucun texte extractible : PDF probablement scanné. Exportez les pages en images pour utiliser l'OCR."
NO_OCR = "no OCR engine is installed"
MOST_BYTES = 50 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOC_PROPERTIES = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}docPr"


class Unsupported(ValueError):
    """A format that can't be read."""


def format_of(filename: str, mimetype: str = "") -> str:
    """SRC-01: extension or MIME type, in order; text else."""
    ext = plain.extension(filename) if "." in filename else ""
    for name, extensions, parts in FORMATS:
        if ext in extensions or any(mimetype.startswith(p) if p.endswith("/") else p in mimetype for p in parts):
            return name
    return "text"


def _runs(node) -> str:
    out = []
    for run in node:
        if run.tag in (f"{_W}hyperlink", f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent"):
            out.append(_runs(run))
            continue
        if run.tag != f"{_W}r":
            continue
        text = ""
        for part in run:
            if part.tag == f"{_W}t":
                text += escape(part.text or "")
            elif part.tag == f"{_W}tab":
                text += " "
            elif part.tag == f"{_W}br":
                text += "<br>"
            elif part.tag == f"{_W}drawing":
                text += "".join(f'<img alt="{escape(p.get("descr") or "", quote=True)}">' for p in part.iter(_DOC_PROPERTIES))
        style = run.find(f"{_W}rPr")
        for tag, name in (("b", "strong"), ("i", "em")):
            on = style.find(f"{_W}{tag}") if style is not None else None
            if on is not None and on.get(f"{_W}val") not in ("0", "false") and text.strip():
                text = f"<{name}>{text}</{name}>"
        out.append(text)
    return "".join(out)


def docx_html(content: bytes) -> str:
    """SRC-06: paragraphs, headings by style, lists, tables, bold and italic runs, alternative texts."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))

    def blocks(parent) -> str:
        out, listed = [], False
        for node in parent:
            item = False
            if node.tag == f"{_W}p":
                style = node.find(f"{_W}pPr/{_W}pStyle")
                name = (style.get(f"{_W}val") or "") if style is not None else ""
                level = re.fullmatch(r"(?:Heading|Titre|heading ?)\s*([1-6])", name) or (["", "1"] if name in ("Title", "Titre") else None)
                item = node.find(f"{_W}pPr/{_W}numPr") is not None
                tag = f"h{level[1]}" if level else "li" if item else "p"
                text = f"<{tag}>{_runs(node)}</{tag}>"
            elif node.tag == f"{_W}tbl":
                rows = ("".join(f"<td>{blocks(c)}</td>" for c in r.iter(f"{_W}tc")) for r in node.iter(f"{_W}tr"))
                text = f"<table>{''.join(f'<tr>{r}</tr>' for r in rows)}</table>"
            else:
                continue
            if item != listed:
                out.append("<ul>" if item else "</ul>")
                listed = item
            out.append(text)
        return "".join(out) + ("</ul>" if listed else "")

    return blocks(root.find(f"{_W}body"))


_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_OPERATION = re.compile(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)\s*(Tj|TJ|'|\")|(T\*|\bET\b|[-0-9.]+\s+[-0-9.]+\s+T[dD])", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        def plain_byte(m):
            c = m[1]
            return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPED.get(c, c)

        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain_byte, raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def pdf_pages(content: bytes) -> list[str]:
    """SRC-07: the text of each page whose content streams are plain or deflated, in order of the streams."""
    if not content.lstrip().startswith(b"%PDF"):
        raise Unsupported("not a PDF")
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", content))
    texts = []
    for m in re.finditer(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", content, re.S):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" not in data:
            continue
        text = ""
        for op in _OPERATION.finditer(data):
            if op[3]:
                text += "" if text.endswith("\n") or not text else "\n"
                continue
            if op[2] in (b"'", b'"') and text and not text.endswith("\n"):
                text += "\n"
            text += "".join(map(_pdf_string, _STRING.findall(op[1])))
        texts.append(text.strip("\n"))
    return texts + [""] * (pages - len(texts))


def convert(content: bytes | None, filename: str | None, mimetype: str | None = "", table_format: str = "compact") -> dict:
    """A file as Markdown: format, markdown, pages, warnings and error. Errors are data; nothing is raised."""
    filename, mimetype, content = filename or "", mimetype or "", bytes(content or b"")
    out: dict = {"format": format_of(filename, mimetype), "markdown": None, "pages": None, "warnings": [], "error": None}
    try:
        kind = out["format"]
        if len(content) > MOST_BYTES:
            raise Unsupported(f"file over {MOST_BYTES >> 20} MB")
        if kind == "doc":
            raise Unsupported(NO_DOC)
        if kind == "image":
            raise Unsupported(NO_OCR)
        if kind == "docx":
            out["markdown"] = html.to_markdown(docx_html(content), docx=True)
        elif kind == "pdf":
            pages = pdf_pages(content)
            out["pages"], out["markdown"] = len(pages), plain.from_pdf_lines("\n\n".join(pages))
            out["warnings"] = [] if out["markdown"] else [NO_TEXT]
        elif kind == "sheet":
            if content.startswith(b"\xd0\xcf\x11\xe0"):
                raise Unsupported("binary XLS workbooks can't be read")
            read = sheets.read_xlsx if content.startswith(b"PK") else sheets.read_csv
            out["markdown"] = sheets.to_markdown(read(content), table_format)
        elif kind == "html":
            out["markdown"] = html.to_markdown(content.decode("utf-8", "replace"))
        else:
            out["markdown"] = plain.from_text(content.decode("utf-8", "replace"), filename)
    except Exception as e:
        out["error"] = f"Failed to convert {filename}: {e}"
    return out
