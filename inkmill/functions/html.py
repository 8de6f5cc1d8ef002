"""HTML as Markdown: ATX headings, fenced code, - bullets, **strong**, _em_, GFM tables, tasks and strikethrough. CONV-20 to 27."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .text import BLANKS

#: Elements whose content isn't text of the page.
SKIPPED = frozenset({"script", "style", "noscript", "template", "iframe", "object", "embed", "canvas", "svg", "head"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCKS = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these, where its end tag is left out.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES |= {b: {"p"} for b in BLOCKS - CLOSES.keys() - {"body", "html", "tbody", "thead", "tfoot"}}
#: How far up an open element is looked for.
FENCES = {"li": {"ul", "ol"}, "p": {"td", "th", "li", "div", "article", "section", "body", "blockquote"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
_SPACE = re.compile(r"[ \t\r\n\f]+")
_ESCAPES = [(re.compile(p), r) for p, r in (
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "),
    ("`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), ("_", r"\\_"), (r"^([0-9]+)\. ", r"\1\\. "),
)]


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A tree of elements and texts; elements that are skipped leave none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.skipping: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            if tag == self.skipping[-1] and tag not in VOID:
                self.skipping.append(tag)
            return
        if tag in SKIPPED:
            if tag not in VOID:
                self.skipping.append(tag)
            return
        shut = CLOSES.get(tag)
        if shut:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in shut:
                    del self.open[i:]
                    break
                if self.open[i].tag in FENCES.get(tag, ()) or (tag not in FENCES and self.open[i].tag in BLOCKS):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if not self.skipping and tag not in VOID and tag not in SKIPPED and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.skipping:
            self.open[-1].children.append(data)


def _escape(text: str) -> str:
    for pattern, to in _ESCAPES:
        text = pattern.sub(to, text)
    return text


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _plain(c) for c in node.children)


class _Writer:
    """Markdown of a tree. docx: images without a source leave their alternative text."""

    def __init__(self, docx: bool = False):
        self.docx = docx

    def inside(self, node: Node) -> str:
        out = ""
        for child in node.children:
            if isinstance(child, str):
                text = _SPACE.sub(" ", child)
                if out[-1:] in ("", "\n", " "):
                    text = text.lstrip(" ")
                out += _escape(text) if text else ""
            else:
                part = self.element(child)
                if child.tag in BLOCKS:
                    out = self.joined(out, part)
                else:
                    out += part.lstrip(" ") if out[-1:] in ("\n", " ") else part
        return out

    @staticmethod
    def joined(before: str, part: str) -> str:
        """Two blocks, apart by the larger of the line ends at their border, two at most."""
        a, b = before.rstrip("\n"), part.lstrip("\n")
        gap = min(2, max(len(before) - len(a), len(part) - len(b)))
        if b and not part.startswith("\n") and a:
            gap = max(gap, 1)
        return (a.rstrip(" ") if gap else a) + "\n" * gap + b

    def element(self, node: Node) -> str:
        tag = node.tag
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n* * *\n\n"
        if tag == "img":
            return self.image(node)
        if tag == "pre":
            return self.code_block(node)
        if tag == "table":
            return self.table(node)
        if tag in ("ul", "ol"):
            return self.items(node)
        if tag == "input":
            return ("[x] " if "checked" in node.attrs else "[ ] ") if node.attrs.get("type") == "checkbox" else ""
        if tag == "code":
            return self.code(node)
        text = self.inside(node)
        bare = text.strip(BLANKS)
        if tag in ("strong", "b", "em", "i", "del", "s", "strike"):
            return self.marked(text, {"strong": "**", "b": "**", "em": "_", "i": "_"}.get(tag, "~~"))
        if tag == "a":
            return self.link(node, text)
        if tag in BLOCKS:
            if not bare:
                return "\n\n" if text else ""
            if re.fullmatch("h[1-6]", tag):
                return f"\n\n{'#' * int(tag[1])} {_SPACE.sub(' ', bare)}\n\n"
            if tag == "blockquote":
                return "\n\n" + re.sub("(?m)^", "> ", bare) + "\n\n"
            return f"\n\n{bare}\n\n"
        return text

    @staticmethod
    def marked(text: str, mark: str) -> str:
        bare = text.strip(BLANKS)
        if not bare:
            return text
        at = text.index(bare)
        return f"{text[:at]}{mark}{bare}{mark}{text[at + len(bare) :]}"

    def link(self, node: Node, text: str) -> str:
        href = node.attrs.get("href", "")
        if not href or not text.strip(BLANKS):
            return text
        title = f' "{_SPACE.sub(" ", node.attrs["title"])}"' if node.attrs.get("title") else ""
        return f"[{text}]({re.sub('([()])', lambda m: chr(92) + m[1], href)}{title})"

    def image(self, node: Node) -> str:
        alt, source = _SPACE.sub(" ", node.attrs.get("alt", "")).strip(), node.attrs.get("src", "")
        if source.lower().startswith("data:") or (self.docx and not source):
            return f"[Image: {alt}]" if alt else ""
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"![{alt}]({source}{title})" if source else ""

    @staticmethod
    def code(node: Node) -> str:
        text = re.sub(r"\r?\n|\r", " ", _plain(node))
        if not text:
            return ""
        ticks = "`"
        while ticks in re.findall("`+", text):
            ticks += "`"
        pad = " " if text[0] == "`" or text[-1] == "`" or (text[0] == " " and text.strip() and text[-1] == " ") else ""
        return f"{ticks}{pad}{text}{pad}{ticks}"

    @staticmethod
    def code_block(node: Node) -> str:
        inner = next((c for c in node.children if isinstance(c, Node) and c.tag == "code"), node)
        language = (re.search(r"(?:^|\s)(?:language|highlight-source)-(\S+)", f"{inner.attrs.get('class', '')} {node.attrs.get('class', '')}") or ["", ""])[1]
        text = _plain(inner).rstrip("\n")
        ticks = "`" * (max([2, *map(len, re.findall(r"(?m)^`{3,}", text))]) + 1)
        return f"\n\n{ticks}{language}\n{text}\n{ticks}\n\n"

    def items(self, node: Node) -> str:
        start = re.fullmatch("-?[0-9]+", node.attrs.get("start", "").strip())
        number = int(start[0]) if start else 1
        out = []
        for child in node.children:
            if not isinstance(child, Node):
                if child.strip(BLANKS):
                    out.append(_escape(_SPACE.sub(" ", child).strip()))
                continue
            content = self.inside(child) if child.tag == "li" else self.element(child)
            loose = any(isinstance(c, Node) and c.tag == "p" for c in child.children)
            bare = content.strip("\n" + BLANKS)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += node.tag == "ol"
            out.append(mark + re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), re.sub(r"\n{2,}(?=(?:- |[0-9]+\. ))", "\n", bare)) + ("\n" if loose else ""))
        return "\n\n" + "\n".join(out).rstrip("\n") + "\n\n" if out else ""

    def rows(self, node: Node):
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "tr":
                    yield child
                elif child.tag in ("thead", "tbody", "tfoot"):
                    yield from self.rows(child)

    def table(self, node: Node) -> str:
        rows = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in self.rows(node)]
        rows = [r for r in rows if r]
        if not rows:
            return "\n\n" + self.inside(node).strip(BLANKS) + "\n\n"
        width = max(map(len, rows))
        text = [[re.sub(r"\s*\n\s*", " ", self.inside(c).strip(BLANKS)).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
        aligned = [c.attrs.get("align", "").lower() for c in rows[0]] + [""] * (width - len(rows[0]))
        rule = [{"left": ":---", "right": "---:", "center": ":---:"}.get(a, "---") for a in aligned]
        return "\n\n" + "\n".join(f"| {' | '.join(r)} |" for r in [text[0], rule, *text[1:]]) + "\n\n"


def to_markdown(html: str | None, docx: bool = False) -> str:
    """SRC-09: Markdown of a page. Navigation and footers are content; comments aren't."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    text = _Writer(docx).inside(tree.root)
    text = re.sub(r"(?<=[^ \t\n])  \n|[ \t]+\n", lambda m: m[0] if m[0] == "  \n" else "\n", text)  # two blanks are a line break
    return re.sub(r"\n{3,}", "\n\n", text).strip(BLANKS)
