"""Sinks: JSONL, a folder of a knowledge base, and ZIP archives. SNK-01 to SNK-06."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.kb import KnowledgeBase, file_rows


def jsonl_line() -> Column:
    """SNK-01: a chunk row as one line; missing fields are left out, the text to embed is made where it's missing."""
    crumbs = F.array_join("breadcrumbs", " > ")
    embed = F.coalesce("embedding_text", F.concat(F.coalesce(crumbs, F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))))
    return F.to_json(F.struct("id", "doc_id", "doc_title", "chunk_index", "title", crumbs.alias("breadcrumbs"), "token_count", F.col("content").alias("text"), embed.alias("embedding_text")))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """SNK-02: chunks as files of JSON lines, in order of (ord, chunk_index)."""
    chunks.repartitionByRange("ord").sortWithinPartitions("ord", "chunk_index").select(jsonl_line().alias("value")).write.text(path)


def write_folder(kb: KnowledgeBase, path: str) -> None:
    """The knowledge base as files that any number of executors write: index texts and JSONL as parts in order, documents and the manifest as JSON."""
    for name in ("llms.txt", "llms-full.txt", "llms-small.txt"):
        lines = kb.lines.filter(F.col("file") == name)
        lines.repartitionByRange("section", "number").sortWithinPartitions("section", "number").select(F.col("line").alias("value")).write.text(f"{path}/{name}")
    write_jsonl(kb.chunks, f"{path}/rag-chunks.jsonl")
    kb.manifest.write.json(f"{path}/manifest")
    file_rows(kb.documents).write.json(f"{path}/manifest-files")
    kb.documents.select("filename", "markdown").write.parquet(f"{path}/docs")


def safe_name(name: str) -> str:
    """The last part of a path, without what could leave the archive's folder."""
    return re.split(r"[/\\]", name)[-1].replace("\0", "").strip() or "document"


def zip_knowledge_base(kb: KnowledgeBase, most_documents: int = 10_000) -> bytes:
    """SNK-03: one archive of a small knowledge base, made on the driver; a larger one raises and belongs in a folder."""
    if kb.documents.limit(most_documents + 1).count() > most_documents:
        raise ValueError(f"over {most_documents} documents: use write_folder")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in ("llms.txt", "llms-full.txt", "llms-small.txt"):
            rows = kb.lines.filter(F.col("file") == name).orderBy("section", "number").collect()
            z.writestr(name, "\n".join(r["line"] for r in rows))
        rows = kb.chunks.orderBy("ord", "chunk_index").select(jsonl_line().alias("line")).collect()
        z.writestr("rag-chunks.jsonl", "\n".join(r["line"] for r in rows))
        manifest = json.loads(kb.manifest.toJSON().first())
        manifest["files"] = [json.loads(r) for r in file_rows(kb.documents).orderBy("ord").drop("ord").toJSON().collect()]
        z.writestr("manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False))
        for r in kb.documents.select("filename", "markdown").toLocalIterator():
            z.writestr(f"docs/{safe_name(r['filename'])}", r["markdown"])
    return out.getvalue()


def zip_files(files: list[tuple[str, str]]) -> bytes:
    """SNK-04: texts under their bare names; equal names are numbered."""
    out, used = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name, text in files:
            new = base = safe_name(name)
            n = 2
            while new in used:
                stem, dot, ext = base.rpartition(".")
                new = f"{stem}-{n}.{ext}" if dot else f"{base}-{n}"
                n += 1
            used.add(new)
            z.writestr(new, text)
    return out.getvalue()
