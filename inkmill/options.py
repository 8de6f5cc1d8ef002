"""Options of a conversion or knowledge base, parsed as leniently as a web form: unknown choices fall back, numbers clamp. API-01, API-14."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from .functions.markdown import LEVELS
from .functions.pii import MODES
from .functions.sheets import FORMATS

#: The least and most of each number.
RANGES = {"chunk_max_tokens": (50, 8000), "chunk_overlap_tokens": (0, 1000), "chunk_min_tokens": (0, 2000)}
TITLE, SUMMARY = "Knowledge Base", "Curated knowledge base optimized for LLM reasoning and token reduction."


def _choice(value, known, default):
    return value if value in known else default


def _bool(value, default: bool) -> bool:
    if value is None:
        return default
    return value is True or str(value).lower() == "true" if not default else not (value is False or str(value).lower() == "false")


def _number(value, name: str, default):
    found = re.match(r"\s*([+-]?[0-9]+)", str(value)) if value is not None else None
    if not found:
        return default
    low, high = RANGES[name]
    return min(max(int(found[1]), low), high)


@dataclass(frozen=True)
class Options:
    level: str = "clean"
    inject_frontmatter: bool = False
    include_chunks: bool = True
    chunk_max_tokens: int = 600
    chunk_overlap_tokens: int | None = None
    chunk_min_tokens: int | None = None
    table_format: str = "compact"
    compact_tables: bool = True
    strip_images: bool = False
    anonymize: bool = False
    anonymize_mode: str = "pseudonymize"
    off: tuple[str, ...] = ()
    title: str = TITLE
    summary: str = SUMMARY

    @classmethod
    def from_mapping(cls, given: Mapping[str, object]) -> Options:
        """From the fields of a request, in camel case."""
        get = given.get
        return cls(
            level=_choice(get("level"), LEVELS, "clean"),
            inject_frontmatter=_bool(get("injectFrontmatter"), False),
            include_chunks=_bool(get("includeRag"), True),
            chunk_max_tokens=_number(get("chunkMaxTokens"), "chunk_max_tokens", 600),
            chunk_overlap_tokens=_number(get("chunkOverlapTokens"), "chunk_overlap_tokens", None),
            chunk_min_tokens=_number(get("chunkMinTokens"), "chunk_min_tokens", None),
            table_format=_choice(get("tableFormat"), FORMATS, "compact"),
            compact_tables=_bool(get("compactTables"), True),
            anonymize=_bool(get("anonymize"), False),
            anonymize_mode=_choice(get("anonymizeMode"), MODES, "pseudonymize"),
            title=str(get("projectTitle") or TITLE)[:200],
            summary=str(get("summary") or SUMMARY)[:1000],
        )

    @classmethod
    def from_form(cls, given: Mapping[str, object]) -> Options:
        """From the fields of a form: the overlap is a percentage, the table format follows from compactTables."""
        most = _number(given.get("chunkMaxTokens"), "chunk_max_tokens", 600)
        percent = min(50, max(0, int(given.get("overlapPercent", 15))))
        style = "compact" if _bool(given.get("compactTables"), True) else "table"
        return cls.from_mapping({**given, "chunkOverlapTokens": int(most * percent / 100 + 0.5), "tableFormat": given.get("tableFormat", style)})
