"""String rules that all operators share: white space, line ends, UTF-16 lengths and exact decimal rounding."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

#: White space: Unicode separators and the byte order mark; \x1c to \x1f and \x85 are not among them.
BLANKS = "\t\n\x0b\x0c\r                  　﻿"
#: The same as the inside of a character class, for Python's and Java's expressions alike.
WS = "\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
S, NS = f"[{WS}]", f"[^{WS}]"
#: Line ends, any other character, and the anchors of a line.
EOL = "\\n\\r\\u2028\\u2029"
DOT = f"[^{EOL}]"
BOL_AT, EOL_AT = f"(?:\\A|(?<=[{EOL}]))", f"(?=[{EOL}]|\\Z)"
_LINES = re.compile(r"\r?\n")
_SPLIT = re.compile(f"{S}+")


def trim(text: str) -> str:
    return text.strip(BLANKS)


def rtrim(text: str) -> str:
    return text.rstrip(BLANKS)


def lines_of(text: str) -> list[str]:
    return _LINES.split(text)


#: Characters on which Python's own splitting and the white space above differ.
_APART = "\x1c\x1d\x1e\x1f\x85\ufeff"


def words_of(text: str | None) -> list[str]:
    text = text or ""
    if not any(c in text for c in _APART):
        return text.split()  # the same words, ten times as fast
    return [w for w in _SPLIT.split(text) if w]


def longest_word(text: str) -> int:
    return max(map(len, words_of(text)), default=0)


def utf16_len(text: str | None) -> int:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    text = text or ""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_cut(text: str, units: int) -> str:
    """The first so many UTF-16 units; a character that would be cut in half stays out."""
    if len(text) <= units // 2:
        return text
    out = text[:units]
    while utf16_len(out) > units:
        out = out[:-1]
    return out


def fixed(value: float, places: int, ties: str = ROUND_HALF_UP) -> float:
    """Rounded by the exact binary value, ties away from zero, or as `ties` says."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ties))


def ascii_word(pattern: str, flags: int = 0) -> re.Pattern[str]:
    """Compile with \\b, \\w and \\d meaning ASCII only, and \\s the white space above."""
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == "\\b" and not inside:
            out.append(edge)
        elif two == "\\s":
            out.append(WS if inside else S)
        elif two == "\\d":
            out.append("0-9" if inside else "[0-9]")
        elif two == "\\w":
            out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    return re.compile("".join(out), flags)
