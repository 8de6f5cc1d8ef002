"""Markdown: code protection, token-reducing rewrites, frontmatter, metadata and structure counts. OPT-*, META-*, TOK-14."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote_plus, unquote_plus, urlsplit

from .text import BLANKS, BOL_AT, DOT, EOL_AT, S, ascii_word, lines_of, rtrim, trim, utf16_cut, utf16_len, words_of
from .tokens import PRICING, analyze, count_tokens, savings

LEVELS = ("raw", "clean", "ultra_compact")

# What the rules look for.
COMMENT = r"<!--[\s\S]*?-->"
EMPTY_TAG = r"<(div|span|p|section|article)[^>]*>\s*</\1>"
PAGE_MARK = r"^\s*(Page\s+\d+(\s*(of|/)\s*\d+)?|\d+\s*/\s*\d+)\s*$"
RULE = r"^[ \t]*([-*_]){3,}[ \t]*$"
RULES = r"---\r?\n(?:---\r?\n)*---"
GLYPH = r"^[ \t]*[•·▪▫►]\s*"
EMPTY_BULLET = r"^\s*[-*+]\s*$"
TRAILING = r"[ \t]+$"
DATA_IMAGE = r"!\[([^\]]*)\]\(\s*data:[^)]*\)"
IMAGE = r"!\[([^\]]*)\]\([^)]+\)"
BLANK_LINES = r"\n{3,}"
RULE_LINE = r"^[ \t]*---[ \t]*$"
LIST_GAP = r"(\n-\s+[^\n]+)\n{2,}(-\s+)"
LINK = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"
FRONTMATTER = r"\A﻿?---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\Z)"
HEADING = r"^(#{1,6})\s+(.+)$"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")
TRIGGERS = ("utm_source", "ref")
STOP_WORDS = ("cette", "votre", "notre", "leurs", "alors", "apres", "comme", "faire", "depuis", "entre", "quelle", "quand")
DESCRIPTION, KEYWORDS, SECTIONS = 220, 6, 8


class Rule:
    """A pattern of the above: ^ and $ are the edges of a line, of any line end, and . is within one.

    A text that holds none of what a match needs isn't searched. Where \n is the only line end the edges are Python's own,
    which are the same there and many times as fast.
    """

    def __init__(self, pattern: str, flags: int = 0, multiline: bool = True, needs: tuple[str, ...] = ()):
        self.needs = needs
        self.any_end = _compiled(pattern, flags, BOL_AT if multiline else "^", EOL_AT if multiline else "$")
        self.one_end = _compiled(pattern, flags | re.M, "^", "$") if multiline else self.any_end

    def of(self, text: str) -> re.Pattern[str] | None:
        if self.needs and not any(n in text for n in self.needs):
            return None
        return self.any_end if "\r" in text or "\u2028" in text or "\u2029" in text else self.one_end

    def sub(self, to, text: str) -> str:
        found = self.of(text)
        return text if found is None else found.sub(to, text)

    def match(self, text: str) -> re.Match[str] | None:
        found = self.of(text)
        return None if found is None else found.match(text)

    def finditer(self, text: str):
        found = self.of(text)
        return iter(()) if found is None else found.finditer(text)


class _Trailing(Rule):
    """Blanks before line ends, where \\n is the only one, by lines: each blank within a line costs nothing."""

    def sub(self, to, text: str) -> str:
        if self.of(text) is self.any_end or to:
            return super().sub(to, text)
        if " \n" in text or "\t\n" in text:
            return "\n".join([line.rstrip(" \t") for line in text.split("\n")])
        return text.rstrip(" \t")


def _compiled(pattern: str, flags: int, start: str, end: str) -> re.Pattern[str]:
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c == "^":
            c = start
        elif not inside and c == "$":
            c = end
        elif not inside and c == ".":
            c = DOT
        out.append(c)
        at += 1
    return ascii_word("".join(out), flags)


def rule(pattern: str, flags: int = 0, multiline: bool = True, *needs: str) -> Rule:
    return Rule(pattern, flags, multiline, needs)


_BOILERPLATE = [
    (rule(COMMENT, 0, True, "<!--"), ""),
    (rule(EMPTY_TAG, re.I, True, "</"), ""),
    (rule(PAGE_MARK, re.I), ""),
    (rule(RULE), "---"),
    (rule(RULES, 0, True, "---\n", "---\r"), "---"),
    (rule(GLYPH, 0, True, *"•·▪▫►"), "- "),
    (rule(EMPTY_BULLET), ""),
    (_Trailing(TRAILING), ""),
]
_TAIL = {
    "clean": [(rule(BLANK_LINES, 0, True, "\n\n\n"), "\n\n"), (_Trailing(TRAILING), "")],
    "ultra_compact": [(rule(RULE_LINE, 0, True, "---"), ""), (rule(LIST_GAP, 0, True, "\n\n-"), r"\1\n\2"), (rule(BLANK_LINES, 0, True, "\n\n\n"), "\n\n")],
}
_DATA_IMAGE, _IMAGE, _LINK = rule(DATA_IMAGE, re.I, True, "]("), rule(IMAGE, 0, True, "]("), rule(LINK, 0, True, "](")
_ROW, _TABLE_RULE, _FRONTMATTER, _HEADING = rule(TABLE_ROW), rule(TABLE_RULE), rule(FRONTMATTER, multiline=False), rule(HEADING)
_FENCE, _CLOSE = re.compile(r" {0,3}(`{3,}|~{3,})"), re.compile(rf" {{0,3}}(`{{3,}}|~{{3,}}){S}*\Z")
_PLACE = re.compile("\0CODE([0-9]+)\0")


@dataclass
class Protected:
    """A text whose fenced code blocks are placeholders, and the blocks."""

    text: str
    blocks: list[str]

    def restore(self, text: str) -> str:
        return text if "\0" not in text else _PLACE.sub(lambda m: self.blocks[int(m[1])] if int(m[1]) < len(self.blocks) else m[0], text)


def protect(text: str) -> Protected:
    """OPT-01: fences of three or more of one mark; closed by as many or more of it, or by the end of the text."""
    if "```" not in text and "~~~" not in text:
        return Protected(text, [])
    kept: list[str] = []
    blocks: list[str] = []
    mark, block = "", []
    for line in text.split("\n"):
        if mark:
            block.append(line)
            end = _CLOSE.match(line)
            if end and end[1][0] == mark[0] and len(end[1]) >= len(mark):
                blocks.append("\n".join(block))
                mark, block = "", []
        elif start := _FENCE.match(line):
            mark, block = start[1], [line]
            kept.append(f"\0CODE{len(blocks)}\0")
        else:
            kept.append(line)
    if mark:
        blocks.append("\n".join(block))
    return Protected("\n".join(kept), blocks)


def without_code(text: str | None) -> str:
    return _PLACE.sub("", protect(text or "").text)


def quoted(value: str) -> str:
    """OPT-04: a JSON string is a YAML scalar."""
    return json.dumps(value, ensure_ascii=False)


@lru_cache(maxsize=1)  # the levels of one document share it
def strip_boilerplate(text: str) -> str:
    for pattern, to in _BOILERPLATE:
        text = pattern.sub(to, text)
    return text


def _rule_cell(cell: str) -> str:
    left, right = cell.startswith(":"), cell.endswith(":")
    return ":---:" if left and right else "---:" if right else ":---" if left else "---"


def compact_tables(text: str) -> str:
    """OPT-13: no padding in table rows; delimiter rows keep their alignment."""
    if "|" not in text:
        return text
    out = []
    for line in lines_of(text):
        if _ROW.match(line):
            cells = [trim(c) for c in trim(line).split("|")[1:-1]]
            if _TABLE_RULE.match(line):
                cells = [_rule_cell(c) for c in cells]
            line = f"|{'|'.join(cells)}|"
        out.append(line)
    return "\n".join(out)


def _alt(found: re.Match[str]) -> str:
    alt = trim(found[1])
    return f"[Image: {alt}]" if alt else ""


def _form(text: str) -> str:
    return quote_plus(text, safe="*-._").replace("~", "%7E")


def clean_link(found: re.Match[str]) -> str:
    """OPT-20: a link that repeats its address is an autolink; where one of the triggers is there, tracking parameters go."""
    text, url = found[1], found[2]
    if text.lower() == url.lower():
        return f"<{url}>"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return found[0]
    if not host:
        return found[0]
    pairs = [p.partition("=")[::2] for p in parts.query.split("&") if p]
    pairs = [(unquote_plus(k), unquote_plus(v)) for k, v in pairs]
    if not any(k in TRIGGERS for k, _ in pairs):
        return found[0]
    query = "&".join(f"{_form(k)}={_form(v)}" for k, v in pairs if k not in TRACKING)
    login = parts.netloc.rpartition("@")[0]
    default = {"http": 80, "https": 443}[parts.scheme]
    place = (f"{login}@" if login else "") + host + (f":{port}" if port and port != default else "")
    mark = f"#{parts.fragment}" if parts.fragment else ""
    return f"[{text}]({parts.scheme}://{place}{parts.path or '/'}{'?' + query if query else ''}{mark})"


def optimize_body(body: str, level: str = "clean", strip_images: bool = False, compact: bool = True) -> str:
    """OPT-21: all rules in order, code untouched."""
    ultra = level == "ultra_compact"
    code = protect(body)
    text = _DATA_IMAGE.sub(_alt, strip_boilerplate(code.text))
    if strip_images or ultra:
        text = _IMAGE.sub(_alt, text)
    if compact or ultra:
        text = compact_tables(text)
    for pattern, to in _TAIL.get(level, ()):
        text = pattern.sub(to, text)
    if ultra:
        text = _LINK.sub(clean_link, text)
    if level in _TAIL:
        text = trim(text)
    return code.restore(text)


def split_frontmatter(text: str | None) -> tuple[str, str]:
    """OPT-22: (leading YAML block or '', body)."""
    text = text or ""
    found = _FRONTMATTER.match(text)
    if not found:
        return "", text
    body = text[found.end() :]
    blank = re.match(rf"{S}*\n", body)
    return rtrim(found[0]), body[blank.end() :] if blank else body


def frontmatter(meta: dict) -> str:
    """OPT-23: the YAML block of a document's metadata; empty fields are left out."""
    top = [quoted(h["text"]) for h in meta["headings"] if h["level"] <= 2][:SECTIONS]
    fields = {
        "title": meta["title"] and quoted(meta["title"]),
        "description": meta["description"] and quoted(meta["description"]),
        "keywords": meta["keywords"] and f"[{', '.join(map(quoted, meta['keywords']))}]",
        "tokens": meta["estimated_tokens"],
        "sections": top and f"[{', '.join(top)}]",
    }
    return "\n".join(["---", *(f"{k}: {v}" for k, v in fields.items() if v), "---"]) + "\n\n"


def keywords(title: str, headings: list[dict]) -> list[str]:
    """META-05: the most frequent words of title and headings. Ties: whole numbers ascending, then by first place."""
    text = re.sub(f"[^A-Za-z0-9_À-ÿ{BLANKS}]", " ", " ".join([title, " ".join(h["text"] for h in headings)]).lower())
    first: dict[str, int] = {}
    times: dict[str, int] = {}
    for at, word in enumerate(w for w in words_of(text) if len(w) > 4 and w not in STOP_WORDS):
        first.setdefault(word, at)
        times[word] = times.get(word, 0) + 1

    def key(word: str):
        whole = word.isascii() and word.isdigit() and (word == "0" or word[0] != "0") and int(word) < 2**32 - 1
        return -times[word], not whole, int(word) if whole else first[word]

    return sorted(times, key=key)[:KEYWORDS]


def _paragraphs(text: str):
    """Parts of a text between empty lines, one by one, since most of it is seldom asked for; a \\r before the gap is left to trim."""
    at = 0
    for gap in re.finditer(r"\n\r?\n", text):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def metadata(text: str | None, filename: str = "") -> dict:
    """META-01 to 06: title, description, headings, keywords and tokens of a Markdown text."""
    if not text:
        return {"title": filename or "Untitled", "description": "", "headings": [], "keywords": [], "estimated_tokens": 0}
    prose = without_code(text)
    headings = [{"level": len(m[1]), "text": trim(m[2])} for m in _HEADING.finditer(prose)]
    first = next((h["text"] for h in headings if h["level"] == 1), None)
    if first is not None:
        title = first
    else:
        line = next((x for x in lines_of(prose) if trim(x)), "")
        title = line.strip("#*_" + BLANKS) or (re.sub(r"\.[^/.]+\Z", "", filename) if filename else "Document")
    paragraphs = map(trim, _paragraphs(prose))
    lead = next((p for p in paragraphs if p and not p.startswith(("#", "|", "```", "---"))), "")
    description = utf16_cut(re.sub(r"\r?\n", " ", lead), DESCRIPTION) + ("..." if utf16_len(lead) > DESCRIPTION else "")
    return {"title": title, "description": description, "headings": headings, "keywords": keywords(title, headings), "estimated_tokens": count_tokens(text)}


def optimize(raw: str | None, level: str = "clean", strip_images: bool = False, compact: bool = True, inject_frontmatter: bool = False, filename: str = "", catalogue=PRICING) -> dict:
    """OPT-24: markdown, body, savings (of bodies) and meta of a document."""
    if not raw:
        return {"markdown": "", "body": "", "savings": savings("", "", catalogue), "meta": metadata("", filename)}
    front, source = split_frontmatter(raw)
    body = source if level == "raw" else optimize_body(source, level, strip_images, compact)
    meta = metadata(body, filename)
    if inject_frontmatter:
        markdown = frontmatter(meta) + body
    elif level == "raw":
        markdown = raw
    else:
        markdown = f"{front}\n\n{body}" if front else body
    return {"markdown": markdown, "body": body, "savings": savings(source, body, catalogue), "meta": meta}


_COUNTED = {
    "headers": rule(r"^#{1,6}\s+.+$"),
    "links": rule(r"\[(.*?)\]\((.*?)\)", 0, True, "]("),
    "images": rule(r"!\[(.*?)\]\((.*?)\)", 0, True, "]("),
    "table_rows": rule(TABLE_ROW),
}


def structure(text: str | None, original: str | None = None, catalogue=PRICING) -> dict:
    """TOK-14, TOK-15: token figures, structure counts, and savings against the original where it differs."""
    text = text or ""
    out = analyze(text, catalogue)
    prose = without_code(text)
    for name, pattern in _COUNTED.items():
        out[name] = sum(1 for _ in pattern.finditer(prose if name == "headers" else text))
    out["lines"] = len(lines_of(text))
    out["reading_time_minutes"] = -(-out["words"] // 200)
    out["savings"] = savings(original, text, catalogue) if original and original != text else None
    return out


def render_safe(text: str | None) -> str:
    """TOK-16: the text with everything that could be HTML escaped; no raw HTML survives."""
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


