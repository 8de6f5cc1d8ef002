"""Markdown as HTML for display. Raw HTML of the input is escaped, never passed on."""

from __future__ import annotations

import re

from .markdown import render_safe as escape

#: Quotes and lists are nested so deep at most; what is deeper is text.
DEEPEST = 16
#: Links of other schemes stay text.
SCHEMES = ("http", "https", "mailto", "tel", "ftp")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])(?: {1,4}(?=\S)|[ \t]*$)")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*")
_CELLS = re.compile(r"(?<!\\)\|")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\([ \t]*<?([^\s()<>]*)>?(?:[ \t]+\"([^\"]*)\")?[ \t]*\)")
_BARE = re.compile(r"<(https?://[^\s<>]+)>|https?://[^\s<>\"\0]+")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f]")
_HELD = re.compile("\0(\\d+)\0")
#: Emphasis in this order, on escaped text.
_MARKS = (
    (re.compile(r"(?<!\*)\*(?!\*)([^*\s](?:[^*]*[^*\s])?)\*(?!\*)"), "em"),
    (re.compile(r"\*\*([^*\s](?:[^*]*[^*\s])?)\*\*"), "strong"),
    (re.compile(r"(?<![\w_])_(?!_)([^_\s](?:[^_]*[^_\s])?)_(?![\w_])"), "em"),
    (re.compile(r"(?<!\w)__([^_\s](?:[^_]*[^_\s])?)__(?!\w)"), "strong"),
    (re.compile(r"~~([^~\s](?:[^~]*[^~\s])?)~~"), "s"),
)


def safe_target(target: str) -> bool:
    """Whether a link may point there. Control characters, which browsers pass over, don't hide a scheme."""
    scheme = _SCHEME.match(_CONTROL.sub("", target))
    return scheme is None or scheme.group(1).lower() in SCHEMES


def inline(text: str) -> str:
    """Code spans, escapes, images, links, bare URLs, emphasis and line breaks of one block."""
    held: list[str] = []

    def hold(html: str) -> str:
        held.append(html)
        return f"\0{len(held) - 1}\0"

    def marked(part: str) -> str:
        part = escape(part)
        for pattern, tag in _MARKS:
            part = pattern.sub(rf"<{tag}>\1</{tag}>", part)
        return part

    def link(m: re.Match) -> str:
        image, label, target, title = m.groups()
        if not safe_target(target) or "\0" in target:
            return m.group()
        named = f' title="{escape(title)}"' if title else ""
        if image:
            return hold(f'<img src="{escape(target)}" alt="{escape(label)}"{named}>')
        return hold(f'<a href="{escape(target)}"{named}>{marked(label)}</a>')

    def bare(m: re.Match) -> str:
        target = m.group(1) or m.group().rstrip(".,;:!?)*_~'")
        return hold(f'<a href="{escape(target)}">{escape(target)}</a>') + ("" if m.group(1) else m.group()[len(target) :])

    def restored(part: str) -> str:
        return _HELD.sub(lambda m: restored(held[int(m.group(1))]), part)

    text = _CODE.sub(lambda m: hold(f"<code>{escape(m.group(2).strip())}</code>"), text)
    text = _ESCAPED.sub(lambda m: hold(escape(m.group(1))), text)
    for _ in range(2):  # images, then links around them
        text = _LINK.sub(link, text)
    text = marked(_BARE.sub(bare, text))
    text = re.sub(r"(?:(?<! ) {2,}|\\)\n", "<br>\n", text)
    return restored(text)


def _table(rows: list[str]) -> str:
    split = [[c.strip() for c in _CELLS.split(r.strip().removeprefix("|").removesuffix("|"))] for r in rows]
    sides = [{(True, True): "center", (False, True): "right", (True, False): "left"}.get((c.startswith(":"), c.endswith(":"))) for c in split[1]]
    out = []
    for cells, tag in [(split[0], "th"), *((r, "td") for r in split[2:])]:
        cells = (cells + [""] * len(sides))[: len(sides)]
        style = [f' style="text-align:{s}"' if s else "" for s in sides]
        out.append("<tr>" + "".join(f"<{tag}{s}>{inline(c)}</{tag}>" for c, s in zip(cells, style)) + "</tr>")
    body = "<tbody>\n" + "\n".join(out[1:]) + "\n</tbody>\n" if out[1:] else ""
    return f"<table>\n<thead>\n{out[0]}\n</thead>\n{body}</table>"


def _list(lines: list[str], at: int, depth: int) -> tuple[str, int]:
    """The list that begins at a line, and the line after it. Its items hold what is indented under them."""
    first = _ITEM.match(lines[at])
    kind = first.group(2)[-1]
    items: list[list[str]] = []
    loose, inner, blank = False, 0, False
    while at < len(lines):
        line = lines[at]
        item = _ITEM.match(line)
        if not line.strip():
            blank = True
            if items:
                items[-1].append("")
        elif items and len(line) - len(line.lstrip(" ")) >= inner:
            loose |= blank
            blank = False
            items[-1].append(line[inner:])
        elif item and item.group(2)[-1] == kind and not _RULE.fullmatch(line):
            loose |= blank and bool(items)
            blank = False
            inner = max(item.end(), item.end(2) + 1)
            items.append([line[inner:]])
        else:
            break
        at += 1
    tag = "ul" if kind in "-*+" else "ol"
    start = int(first.group(2)[:-1]) if tag == "ol" else 1
    parts = "\n".join(f"<li>{_blocks(i, depth + 1, tight=not loose)}</li>" for i in items)
    return f"<{tag}{f' start=\"{start}\"' if start != 1 else ''}>\n{parts}\n</{tag}>", at


def _blocks(lines: list[str], depth: int = 0, tight: bool = False) -> str:
    out: list[str] = []
    held: list[str] = []

    def flush(tag: str | None = None) -> None:
        if held:
            body = inline("\n".join(line.lstrip() for line in held).rstrip())
            out.append(f"<{tag}>{body}</{tag}>" if tag else body if tight else f"<p>{body}</p>")
            held.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip():
            flush()
        elif m := _FENCE.fullmatch(line):
            flush()
            end = re.compile(rf" {{0,3}}{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}[ \t]*")
            body = at
            while at < len(lines) and not end.fullmatch(lines[at]):
                at += 1
            language = m.group(2).split()[:1]
            named = f' class="language-{escape(language[0])}"' if language else ""
            out.append(f"<pre><code{named}>" + "".join(escape(c) + "\n" for c in lines[body:at]) + "</code></pre>")
            at += 1
        elif m := _HEADING.match(line):
            flush()
            title = line[m.end() :].strip()
            bare = title.rstrip("#")
            title = bare.rstrip() if not bare or bare[-1] in " \t" else title
            out.append(f"<h{len(m.group(1))}>{inline(title)}</h{len(m.group(1))}>")
        elif held and (m := _UNDERLINE.fullmatch(line)):
            flush("h1" if m.group(1)[0] == "=" else "h2")
        elif _RULE.fullmatch(line):
            flush()
            out.append("<hr>")
        elif line.lstrip(" ").startswith(">") and depth < DEEPEST:
            flush()
            inside = [line]
            while at < len(lines) and lines[at].lstrip(" ").startswith(">"):
                inside.append(lines[at])
                at += 1
            out.append(f"<blockquote>\n{_blocks([q.lstrip(' ')[1:].removeprefix(' ') for q in inside], depth + 1)}\n</blockquote>")
        elif _ITEM.match(line) and depth < DEEPEST:
            flush()
            html, at = _list(lines, at - 1, depth)
            out.append(html)
        elif "|" in line and at < len(lines) and "|" in lines[at] and _DELIMITER.fullmatch(lines[at]):
            flush()
            rows = [line, lines[at]]
            at += 1
            while at < len(lines) and "|" in lines[at]:
                rows.append(lines[at])
                at += 1
            out.append(_table(rows))
        else:
            held.append(line)
    flush()
    return "\n".join(out)


def to_html(text: str | None) -> str:
    """API-06: headings, paragraphs, quotes, lists, fenced code, tables, rules and inline marks as HTML; the rest is escaped.

    Null and empty texts give nothing; tabs become blanks. Not rendered: indented code, reference links, typographic quotes.
    """
    lines = (text or "").replace("\0", "\ufffd").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    return _blocks(lines)
