"""One Arrow UDF for each stage that folds over a document: convert, anonymise, optimise, analyse, count, chunk.

Each wraps a pure function of strings, evaluated batch by batch; stages that a query doesn't use are pruned by the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .. import schemas
from ..functions import chunks, files, html, markdown, pii, plain, render, tokens
from ..options import Options


def _shaped(value, kind: DataType):
    """A value as Arrow wants it: maps as pairs."""
    if value is None:
        return None
    if isinstance(kind, MapType):
        return list(value.items())
    if isinstance(kind, StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, MapType)):
        return [_shaped(v, kind.elementType) for v in value]
    return value


#: A stage makes Python values of so many rows at a time, or of as many as hold about so many bytes.
ROWS, BYTES = 256, 1 << 20


def slices(batch: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """A batch in parts of at most ROWS rows and, by its average row, BYTES bytes; at least one row each."""
    n = len(batch[0])
    step = min(ROWS, max(1, n * BYTES // max(1, sum(c.nbytes for c in batch))))
    for at in range(0, n, step):
        yield tuple(c.slice(at, step) for c in batch)


def stage(function: Callable, ddl: str, counts: bool = False) -> Callable[..., Column]:
    """A column function from one of Python values; it needs a session. If it counts tokens, a worker without the driver's encodings fails.

    Spark's batches hold up to 10,000 rows, whatever their texts: a stage takes them in slices and sends each slice's results
    at once, so that a worker holds one batch of its inputs and one slice of Python values and results.
    """
    kind = DataType.fromDDL(ddl)
    arrow = to_arrow_type(kind)
    nested = isinstance(kind, (StructType, ArrayType, MapType))
    named = tokens.encoders() if counts else None

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        if named:
            tokens.require(named)
        for batch in batches:
            for part in slices((batch,) if isinstance(batch, pa.Array) else batch):
                rows = (function(*row) for row in zip(*(c.to_pylist() for c in part)))
                yield pa.array([_shaped(r, kind) for r in rows] if nested else list(rows), type=arrow)

    return F.arrow_udf(run, kind)


def convert(content: Column, filename: Column, mimetype: Column | None = None, options: Options = Options()) -> Column:
    style = options.table_format
    return stage(lambda c, f, m: files.convert(c, f, m, style), schemas.CONVERTED)(content, filename, F.lit("") if mimetype is None else mimetype)


def anonymize(text: Column, mode: str = "pseudonymize", off: tuple[str, ...] = ()) -> Column:
    return stage(lambda t: pii.anonymize(t, mode, off), schemas.ANONYMIZED)(text)


def optimize(text: Column, filename: Column, options: Options = Options()) -> Column:
    o = options
    return stage(lambda t, f: markdown.optimize(t, o.level, o.strip_images, o.compact_tables, o.inject_frontmatter, f or "", tokens.load_pricing()), schemas.OPTIMIZED, True)(text, filename)


def optimize_counted(text: Column, filename: Column, options: Options = Options()) -> Column:
    """The same with the tokens of the Markdown, whose lines are counted already."""
    o = options

    def run(t, f):
        done = markdown.optimize(t, o.level, o.strip_images, o.compact_tables, o.inject_frontmatter, f or "", tokens.load_pricing())
        return done | {"tokens": tokens.count_tokens(done["markdown"])}

    return stage(run, schemas.COUNTED, True)(text, filename)


def optimize_each(text: Column, filename: Column, levels: dict[str, Options]) -> Column:
    """The same at several levels in one pass, so that what they share is counted once: a struct with a field a level."""

    def run(t, f):
        return {n: markdown.optimize(t, o.level, o.strip_images, o.compact_tables, o.inject_frontmatter, f or "", tokens.load_pricing()) for n, o in levels.items()}

    return stage(run, f"struct<{', '.join(f'{n}: {schemas.OPTIMIZED}' for n in levels)}>", True)(text, filename)


def analyze(text: Column) -> Column:
    return stage(tokens.analyze, schemas.ANALYSIS, True)(text)


def structure(text: Column, original: Column) -> Column:
    return stage(markdown.structure, schemas.STATS, True)(text, original)


def count_tokens(text: Column, encoding: str = tokens.PRIMARY) -> Column:
    return stage(lambda t: tokens.count_tokens(t, encoding), "bigint", True)(text)


def encode(text: Column) -> Column:
    return stage(lambda t: tokens.encode(t or "") or [], "array<int>", True)(text)


def decode(ids: Column) -> Column:
    return stage(lambda i: tokens.decode(i or []), "string", True)(ids)


def chunk(text: Column, doc_id: Column, title: Column, options: Options = Options()) -> Column:
    o = options
    return stage(lambda t, d, n: chunks.chunk(t, d, n or "Document", o.chunk_max_tokens, o.chunk_overlap_tokens, o.chunk_min_tokens), schemas.CHUNKS, True)(text, doc_id, title)


def sections(text: Column, title: Column) -> Column:
    def run(t, n):
        return [{"title": p.title, "breadcrumbs": p.trail, "content": p.content, "tokens": p.tokens} for p in chunks.sections(t or "", n or "Document")]

    return stage(run, schemas.SECTIONS, True)(text, title)


def metadata(text: Column, filename: Column) -> Column:
    return stage(lambda t, f: markdown.metadata(t, f or ""), schemas.META, True)(text, filename)


def html_markdown(page: Column) -> Column:
    return stage(html.to_markdown, "string")(page)


def text_markdown(text: Column, filename: Column) -> Column:
    return stage(lambda t, f: plain.from_text(t or "", f or ""), "string")(text, filename)


def pdf_markdown(lines: Column) -> Column:
    return stage(plain.from_pdf_lines, "string")(lines)


def ocr_markdown(lines: Column, confidence: Column) -> Column:
    return stage(plain.from_ocr_lines, "string")(lines, confidence)


def optimize_body(text: Column, level: str = "clean") -> Column:
    return stage(lambda t: markdown.optimize_body(t or "", level), "string")(text)


def restore_code(text: Column) -> Column:
    """The text after its code blocks were taken out and put back: equal to it."""

    def run(t):
        code = markdown.protect(t or "")
        return code.restore(code.text)

    return stage(run, "string")(text)


def generated_frontmatter(text: Column, filename: Column) -> Column:
    return stage(lambda t, f: markdown.frontmatter(markdown.metadata(t, f or "")), "string", True)(text, filename)


def restored(text: Column, originals: Column) -> Column:
    return stage(lambda t, o: pii.restore(t or "", dict(o or {})), "string")(text, originals)


def safe_html(text: Column) -> Column:
    return stage(markdown.render_safe, "string")(text)


def rendered(text: Column) -> Column:
    return stage(render.to_html, "string")(text)


def without_code(text: Column) -> Column:
    return stage(markdown.without_code, "string")(text)


def savings(original: Column, optimized: Column, ties: str = ROUND_HALF_UP) -> Column:
    return stage(lambda a, b: tokens.savings(a, b, ties=ties), schemas.SAVINGS, True)(original, optimized)


def costs(counted: Column) -> Column:
    return stage(lambda n: tokens.costs(n or 0), schemas.COSTS)(counted)


def embedding_text(trail: Column, content: Column) -> Column:
    return stage(lambda t, c: chunks.embedding_text(list(t or []), c or ""), "string")(trail, content)
