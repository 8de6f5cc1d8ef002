"""The service's requests as functions of DataFrames. API-03 to API-11."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators import stages
from ..options import Options
from ..sources import writers
from . import kb


def convert(files: DataFrame, given: Mapping[str, object] | None = None) -> DataFrame:
    """API-03, API-04: files (ord, path, content) as results: success, error, Markdown, stats, savings, chunks and entities."""
    options = Options.from_mapping(given or {})
    done = kb.convert(files, options)
    good = kb.process(done.select("ord", "filename", "markdown"), options)
    stats = good.withColumn("stats", stages.structure(F.col("markdown"), F.col("raw"))).drop("original_filename", "raw")
    facts = done.select("ord", F.col("filename").alias("original_filename"), "format", "pages", "warnings", "error", F.col("error").isNull().alias("success"))
    return facts.join(stats, "ord", "left")


def optimize_text(texts: DataFrame, given: Mapping[str, object] | None = None) -> DataFrame:
    """API-05: texts (ord, filename, markdown) anonymised, optimised, analysed and chunked. The file name's last 255 characters count."""
    options = Options.from_mapping(given or {})
    named = texts.withColumn("filename", F.substring(F.coalesce("filename", F.lit("document.md")), -255, 255))
    return kb.process(named, options).withColumn("stats", stages.structure(F.col("markdown"), F.col("raw")))


def analyze_markdown(texts: DataFrame) -> DataFrame:
    """API-06: texts (ord, markdown) with stats, rendered as HTML, and as an escaped text that holds no HTML."""
    return texts.select("ord", stages.structure(F.col("markdown"), F.lit(None).cast("string")).alias("stats"), stages.rendered(F.col("markdown")).alias("html"), stages.safe_html(F.col("markdown")).alias("escaped"))


def knowledge_base(docs: DataFrame, given: Mapping[str, object] | None = None) -> kb.KnowledgeBase:
    """API-07: invalid documents are left out; frontmatter and chunks always."""
    return kb.build(docs, replace(Options.from_mapping(given or {}), inject_frontmatter=True))


def export_jsonl(chunks: DataFrame) -> DataFrame:
    """API-08: a line of JSON for each chunk that has an id."""
    return chunks.filter("id is not null").select(writers.jsonl_line().alias("value"))


def download_zip(results: DataFrame, most: int = 1_000) -> bytes:
    """API-09: converted documents under their names in one archive; bounded, since it is made on the driver."""
    rows = results.filter("markdown is not null").select("filename", "markdown").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} documents: write them to a folder")
    return writers.zip_files([(r["filename"], r["markdown"]) for r in rows])


def batch_economy(results: DataFrame) -> DataFrame:
    """KB-12: the token economy over the results that succeeded."""
    return kb.batch_economy(results.filter("success"))


def status(spark: SparkSession) -> DataFrame:
    """API-10."""
    return kb.capabilities(spark)


def preview(results: DataFrame, title: str = "Knowledge Base") -> DataFrame:
    """KB-14: (number, line) of a short index of results that were converted."""
    line = F.concat(F.lit("- ["), kb.title_column(), F.lit("]("), F.col("filename"), F.lit("): ~"), F.col("stats.tokens").cast("string"), F.lit(" tokens"))
    lines = kb.ranked(results.filter("markdown is not null").select("ord", line.alias("line")))
    head = results.sparkSession.createDataFrame([(0, f"# {title}")], "number long, line string")
    return head.unionByName(lines)


def estimated(texts: DataFrame) -> DataFrame:
    """Tokens by length alone, where no vocabulary is at hand."""
    return texts.select("ord", native.estimate_tokens(F.col("markdown")).alias("tokens"))
