"""Text, code, JSON, RTF, PDF lines and OCR lines as Markdown. CONV-01 to 07, CONV-30 to 51."""

from __future__ import annotations

import json
import re

from .text import S, lines_of, rtrim, trim

# Language names by extension.
LANGUAGES = {
    "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx",
    "py": "python", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "php": "php",
    "html": "html", "css": "css", "scss": "scss", "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "sql": "sql", "graphql": "graphql",
    "dockerfile": "dockerfile", "tf": "hcl", "ini": "ini",
}

# What the lines of PDFs and scans look like.
_ARTEFACTS = [re.compile(p, re.I) for p in (rf"Page{S}+[0-9]+({S}*(of|sur|/){S}*[0-9]+)?\Z", rf"[0-9]+{S}*/{S}*[0-9]+\Z", rf"[-–—]+{S}*[0-9]+({S}+(of|sur){S}+[0-9]+)?{S}*[-–—]+\Z")]
_NUMBERED = re.compile(rf"([0-9]+(\.[0-9]+)*\.?|[A-Z]\.){S}+[A-Z0-9À-Ý][^\n\r]*\Z")
_OPEN_END = re.compile(r"[.:;,]\Z")
_CAPITALS = re.compile(r"[A-ZÀ-Ý]{3}")
_PDF_CAPS = re.compile(rf"(?:[A-Z0-9À-Ý_:-]|{S}){{3,60}}\Z")
_OCR_CAPS = re.compile(rf"(?:[A-Z0-9À-Ý_:-]|{S}){{3,50}}\Z")
_SMALL = frozenset({"AND", "THE", "FOR", "WITH", "PAR", "POUR"})
_CHAPTER = re.compile(rf"(Chapitre|Chapter|Section|Partie|Part|Annexe|Appendix){S}+[0-9]+(?::|{S})", re.I)
_PDF_BULLET = re.compile(rf"[•●▪◦‣\-*–—]{S}+(.+)\Z")
_OCR_BULLET = re.compile(rf"[•●▪◦‣\-*]{S}+(.+)\Z")
_ITEM = re.compile(rf"([0-9]{{1,3}})[.)]{S}+(.+)\Z")
_LETTER = re.compile(rf"[a-z]\){S}+(.+)\Z")
_COLUMNS = re.compile(rf"{S}{{3,}}|\t")
_HYPHEN = re.compile(r"[a-zà-ÿ]-\Z")
_STOPS = (".", "!", "?", ":")
_GAPS = re.compile(r"\n{3,}")


def extension(filename: str) -> str:
    """CONV-07: after the last dot; a name without one is its own extension."""
    return filename.rpartition(".")[2].lower()


def fence(content: str, language: str) -> str:
    """CONV-02: with one tick more than any run inside, three at least."""
    ticks = "`" * (max([2, *map(len, re.findall("`+", content))]) + 1)
    return f"{ticks}{language}\n{rtrim(content)}\n{ticks}"


def _number(value):
    """Numbers as JavaScript prints them: whole floats without a fraction."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, list):
        return [_number(v) for v in value]
    if isinstance(value, dict):
        return {k: _number(v) for k, v in value.items()}
    return value


def from_rtf(content: str) -> str:
    """CONV-05."""
    text = re.sub(r"\\pard?", "\n", content)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(rf"\\[a-zA-Z0-9-]+{S}?", "", text)
    return trim(text.replace("{", "").replace("}", ""))


def from_text(content: str, filename: str = "") -> str:
    """SRC-11: JSON and code in fences, RTF stripped, other text trimmed."""
    ext = extension(filename)
    if ext == "json":
        try:
            content = json.dumps(_number(json.loads(content)), indent=2, ensure_ascii=False)
        except ValueError:
            pass
        return fence(content, "json")
    if ext in LANGUAGES:
        return fence(content, LANGUAGES[ext])
    if ext == "rtf" or content.startswith("{\\rtf"):
        return from_rtf(content)
    return trim(content)


def _heading(line: str) -> str | None:
    """CONV-42, CONV-43: the line as a heading, if it is one."""
    chapter = _CHAPTER.match(line)
    numbered = _NUMBERED.match(line) and len(line) < 90 and not _OPEN_END.search(line)
    capitals = _PDF_CAPS.match(line) and _CAPITALS.search(line) and line.upper() not in _SMALL
    if not (chapter or numbered or capitals):
        return None
    depth = len((re.match(r"[0-9]+(\.[0-9]+)*", line) or [""])[0].split("."))
    marks = "#" if chapter else "#" * min(max(depth, 1), 3) + "#" if depth > 1 else "##"
    return f"{marks} " + re.sub(rf"\A#+{S}*", "", line)


def _item(line: str) -> str | None:
    """CONV-44 to 47: a bullet, numbered or lettered item, or a row of columns."""
    if m := _PDF_BULLET.match(line):
        return f"- {m[1]}"
    if len(line) < 140:
        if m := _ITEM.match(line):
            return f"{m[1]}. {m[2]}"
        if m := _LETTER.match(line):
            return f"- {m[1]}"
    cells = [c for c in (trim(c).replace("|", "\\|") for c in _COLUMNS.split(line)) if c]
    return f"|{'|'.join(cells)}|" if len(cells) > 1 else None


def _tables(lines: list[str]) -> list[str]:
    """CONV-49: runs of rows become tables of one width; a row alone becomes text."""
    out: list[str] = []
    block: list[list[str]] = []
    for line in [*lines, ""]:
        if line.startswith("|"):
            block.append(line.split("|")[1:-1])
            continue
        if len(block) == 1:
            out.append(" | ".join(block[0]))
        elif block:
            width = max(map(len, block))
            rows = [f"|{'|'.join(r + [''] * (width - len(r)))}|" for r in block]
            out += [rows[0], f"|{'|'.join(['---'] * width)}|", *rows[1:]]
        block = []
        out.append(line)
    return out[:-1]


def from_pdf_lines(text: str | None) -> str:
    """CONV-51: headings, lists, tables and flowing paragraphs from a PDF's lines. A paragraph is joined once, however long it gets."""
    out: list[str] = []
    flow: list[str] = []  # the parts of the open paragraph

    def close() -> None:
        if flow:
            out.append("".join(flow))
            flow.clear()

    for line in map(trim, lines_of(text or "")):
        bare = line.isalpha() and "a" <= line[0] <= "z"  # one word in small letters is neither a mark nor a heading nor an item
        if line and not bare and any(p.match(line) for p in _ARTEFACTS):
            continue
        made = None if bare else [] if not line else ["", heading, ""] if (heading := _heading(line)) else [item] if (item := _item(line)) else None
        if made is None:
            if flow and not flow[-1].endswith(_STOPS):
                if flow[-1].endswith("-") and _HYPHEN.search(flow[-1]):
                    flow[-1] = flow[-1][:-1]
                else:
                    flow.append(" ")
            else:
                close()
            if not flow and (line.startswith(("#", "- ", "|", ">")) or re.match(r"[0-9]+\. ", line)):
                out.append(line)  # nothing is appended to it
            else:
                flow.append(line)
            continue
        close()
        out += made if line else [""] if out and out[-1] else []
    close()
    return trim(_GAPS.sub("\n\n", "\n".join(_tables(out))))


def from_ocr_lines(text: str | None, confidence: float | None = 0) -> str:
    """CONV-30 to 33: a banner with the confidence, headings in capitals, bullets."""
    out = [f"> 📷 *Texte extrait par OCR (Confiance: {int((confidence or 0) + 0.5)}%)*", ""]
    for line in map(trim, lines_of(text or "")):
        if not line:
            out += [""] if out[-1] else []
        elif _OCR_CAPS.match(line) and _CAPITALS.search(line):
            out += ["", f"## {line}", ""]
        else:
            bullet = _OCR_BULLET.match(line)
            out.append(f"- {bullet[1]}" if bullet else line)
    return trim(_GAPS.sub("\n\n", "\n".join(out)))
