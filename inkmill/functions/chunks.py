"""Chunks for retrieval, cut along headings, paragraphs, lines, sentences and tokens in turn. CHK-01 to CHK-19."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import regex

from .markdown import protect
from .text import S, lines_of, trim, utf16_len
from .tokens import UNITS_PER_TOKEN, count_tokens, decode, encode

#: The smallest maximum, the defaults, and what two joined pieces cost.
FLOOR, MAXIMUM, MINIMUM, OVERLAP = 32, 600, 150, 0.15
JOIN, JOIN_COST = "\n\n", 1
HEADING = re.compile(rf"(#{{1,4}}){S}+([^\n\r  ]+?){S}*#*{S}*\Z")
DELIMITER = re.compile(rf"{S}*\|?{S}*:?-{{3,}}:?{S}*(\|{S}*:?-{{3,}}:?{S}*)*\|?{S}*\Z")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
SENTENCE = regex.compile(rf"(?<=[.!?…]){S}+(?=[\p{{Lu}}\p{{N}}\"«(])")
SENTENCE_END = re.compile(rf"(?<=[.!?…]){S}+")
PARAGRAPH = re.compile(rf"\n{S}*\n")


@dataclass(frozen=True)
class Limits:
    """CHK-02: the most tokens of a chunk, the overlap, and the least tokens of a section that stands alone."""

    most: int
    overlap: int
    least: int

    @classmethod
    def of(cls, most=None, overlap=None, least=None) -> Limits:
        most = max(FLOOR, int(most or MAXIMUM))
        overlap = int(most * OVERLAP + 0.5) if overlap is None else int(overlap)
        least = MINIMUM if least is None else int(least)
        return cls(most, min(max(0, overlap), most // 2), min(max(0, least), most))


@dataclass
class Part:
    """Sections joined into one, with what it takes to name and place them."""

    title: str
    trail: list[str]
    content: str
    tokens: int
    large: bool = False

    def add(self, other: Part, tokens: int) -> None:
        self.content, self.tokens, self.trail = self.content + JOIN + other.content, tokens, shared_trail(self.trail, other.trail)


def content_id(text: str) -> str:
    """CHK-01."""
    return "doc_" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def shared_trail(a: list[str], b: list[str]) -> list[str]:
    """CHK-07: the common beginning of two breadcrumb trails, at least the first crumb."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[: max(n, 1)]


def sections(text: str, title: str) -> list[Part]:
    """CHK-03: (title, trail, content) between headings of levels 1 to 4; those without a body are dropped."""
    code = protect(text)
    starts: list[tuple[str, list[str], list[str]]] = [(title, [title], [])]
    levels: dict[int, str] = {}
    for line in lines_of(code.text):
        found = HEADING.match(line)
        if found:
            level, name = len(found[1]), trim(found[2])
            levels = {k: v for k, v in levels.items() if k < level} | {level: name}
            path = [levels[k] for k in sorted(levels)]
            starts.append((name, [title, *(path[1:] if path[0] == title else path)], [line]))
        else:
            starts[-1][2].append(line)
    out = []
    for number, (name, trail, lines) in enumerate(starts):
        if any(map(trim, lines[1:] if number else lines)):
            content = trim(code.restore("\n".join(lines)))
            out.append(Part(name, trail, content, count_tokens(content)))
    return out


def merged(parts: list[Part], limits: Limits) -> list[Part]:
    """CHK-04 to 06: small sections join their neighbours as long as the result fits."""
    done: list[Part] = []
    open_: Part | None = None

    def joint(a: Part, b: Part) -> int | None:
        tokens = count_tokens(a.content + JOIN + b.content)
        return tokens if tokens <= limits.most else None

    def close() -> None:
        nonlocal open_
        if open_ is None:
            return
        fits = None
        if open_.tokens < limits.least and done and not done[-1].large:
            fits = joint(done[-1], open_)
        if fits is None:
            done.append(open_)
        else:
            done[-1].add(open_, fits)
        open_ = None

    for part in parts:
        if part.tokens > limits.most:
            part.large = True
            if open_ is not None and open_.tokens < limits.least and (not done or done[-1].large):
                part.content, part.title, part.trail = open_.content + JOIN + part.content, open_.title, shared_trail(open_.trail, part.trail)
                open_ = None
            close()
            done.append(part)
            continue
        if open_ is not None and open_.tokens < limits.least and (tokens := joint(open_, part)) is not None:
            open_.add(part, tokens)
            continue
        close()
        open_ = part
    close()
    return done


def token_windows(text: str, most: int) -> list[str]:
    """CHK-14."""
    ids = encode(text)
    if ids is None:
        step = max(1, int(most * UNITS_PER_TOKEN))
        return [text[i : i + step] for i in range(0, len(text), step)]
    return [decode(ids[i : i + most]) for i in range(0, len(ids), most)]


def table_parts(text: str, most: int) -> list[str] | None:
    """CHK-11: a table's rows in parts that repeat its head; None for other texts and heads that leave too little room."""
    lines = text.split("\n")
    if len(lines) < 3 or not trim(lines[0]).startswith("|") or not DELIMITER.match(lines[1]):
        return None
    head = "\n".join(lines[:2])
    room = most - count_tokens(head) - 1
    if room < FLOOR:
        return None
    parts: list[list[str]] = [[]]
    used = 0
    for row in lines[2:]:
        cost = count_tokens(row) + 1
        if parts[-1] and used + cost > room:
            parts.append([])
            used = 0
        parts[-1].append(row)
        used += cost
    return ["\n".join([head, *rows]) for rows in parts if rows]


def broken(text: str, most: int) -> list[str]:
    """CHK-12, CHK-13: a text over the maximum in smaller ones: table rows, lines, sentences, or windows of tokens."""
    table = table_parts(text, most)
    if table is not None:
        return table
    lines = text.split("\n")
    many = len(lines) > 1
    pieces = lines if many else SENTENCE.split(text)
    if len(pieces) < 2:
        return token_windows(text, most)
    out: list[str] = []
    held: list[str] = []
    used = 0

    def emit() -> None:
        nonlocal held, used
        if held:
            out.append(("\n" if many else " ").join(held))
        held, used = [], 0

    for piece in pieces:
        cost = count_tokens(piece)
        if cost > most:
            emit()
            out += broken(piece, most)
            continue
        if used + cost + 1 > most:
            emit()
        held.append(piece)
        used += cost + 1
    emit()
    fence = FENCE.match(text)
    if fence and len(out) > 1:
        last = len(out) - 1
        out = [(f"{lines[0]}\n" if i else "") + part + (f"\n{fence[1]}" if i < last else "") for i, part in enumerate(out)]
    return out


def last_sentences(text: str, room: int) -> str:
    """CHK-10: the last sentences that fit, never all of them, never of code or tables."""
    if room <= 0 or FENCE.match(text) or trim(text).startswith("|"):
        return ""
    sentences = SENTENCE_END.split(text)
    start, used = len(sentences), 0
    while start > 1:
        used += count_tokens(sentences[start - 1]) + 1
        if used > room:
            break
        start -= 1
    return " ".join(sentences[start:])


def packed(content: str, limits: Limits) -> list[str]:
    """CHK-08, CHK-09: paragraphs in chunks of at most the maximum; each next chunk begins with the end of the one before."""
    code = protect(content)
    units: list[tuple[str, int]] = []
    for paragraph in PARAGRAPH.split(code.text):
        unit = trim(code.restore(paragraph))
        if unit:
            units += [(u, count_tokens(u)) for u in (broken(unit, limits.most) if count_tokens(unit) > limits.most else [unit])]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    used = 0
    for text, tokens in units:
        if held and used + tokens + JOIN_COST > limits.most:
            out.append(JOIN.join(u for u, _ in held))
            start, kept = len(held), 0
            while limits.overlap and start > 1:
                cost = held[start - 1][1] + JOIN_COST
                if kept + cost > limits.overlap or kept + cost + tokens > limits.most:
                    break
                kept += cost
                start -= 1
            tail = ""
            if start == len(held) and limits.overlap:
                tail = last_sentences(held[-1][0], min(limits.overlap, limits.most - tokens - JOIN_COST))
            if tail:
                size = count_tokens(tail)
                held, used = [(tail, size)], size + JOIN_COST
            else:
                held, used = held[start:], kept
        held.append((text, tokens))
        used += tokens + (JOIN_COST if len(held) > 1 else 0)
    if held:
        out.append(JOIN.join(u for u, _ in held))
    return out


def embedding_text(trail: list[str], content: str) -> str:
    """CHK-17."""
    return " > ".join(trail) + "\n\n" + content


def chunk(text: str | None, doc_id: str | None = None, title: str = "Document", most=None, overlap=None, least=None) -> list[dict]:
    """CHK-16, CHK-19: the chunks of a Markdown body, numbered from 1."""
    if not text or not trim(text):
        return []
    limits = Limits.of(most, overlap, least)
    name = doc_id or content_id(text)
    out: list[dict] = []
    for part in merged(sections(text, title), limits):
        pieces = packed(part.content, limits) if part.large else [part.content]
        for i, content in enumerate(pieces, 1):
            number = len(out) + 1
            out.append({
                "id": f"{name}_chunk_{number}",
                "doc_id": name,
                "doc_title": title,
                "chunk_index": number,
                "title": f"{part.title} (Partie {i})" if len(pieces) > 1 else part.title,
                "breadcrumbs": part.trail,
                "content": content,
                "embedding_text": embedding_text(part.trail, content),
                "token_count": count_tokens(content),
                "char_count": utf16_len(content),
            })
    return out


#: Field of a JSONL record, and the names under which a chunk may hold it.
FIELDS = {
    "id": ("id",),
    "doc_id": ("doc_id", "docId"),
    "doc_title": ("doc_title", "docTitle"),
    "chunk_index": ("chunk_index", "chunkIndex"),
    "title": ("title",),
    "token_count": ("token_count", "tokenCount"),
    "text": ("content", "text"),
}


def jsonl(record: dict) -> str:
    """SNK-01: one line of JSON; missing fields are left out, the text to embed is made where it's missing."""

    def first(*names):
        return next((record[n] for n in names if record.get(n) is not None), None)

    values = {k: first(*names) for k, names in FIELDS.items()}
    crumbs = first("breadcrumbs")
    trail = [crumbs] if isinstance(crumbs, str) else list(crumbs or [])
    text = first("embedding_text", "embeddingText")
    order = {k: values[k] for k in ("id", "doc_id", "doc_title", "chunk_index", "title")}
    order |= {"breadcrumbs": first("breadcrumbsStr") or (" > ".join(trail) if crumbs is not None else None), "token_count": values["token_count"], "text": values["text"]}
    order["embedding_text"] = embedding_text(trail, values["text"] or "") if text is None else text
    return json.dumps({k: v for k, v in order.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))


