"""The registered queries of the document engine and their SQL."""

from __future__ import annotations

from . import queries_documents, queries_exact, queries_text

QUERIES = {**queries_text.QUERIES, **queries_documents.QUERIES, **queries_exact.QUERIES}
ORACLES: dict[str, str] = {**queries_text.ORACLES, **queries_documents.ORACLES, **queries_exact.ORACLES}
