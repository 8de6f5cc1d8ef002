"""Knowledge bases: documents processed one by one, chunks, index files and a manifest. KB-01 to KB-14, API-03 to API-10."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..functions import native, tokens
from ..operators import stages
from ..options import Options
from ..sources import readers
from ..sources.readers import fresh, reliable, shared_folder  # noqa: F401

MOST_IN_CONTEXT = 200_000
#: Lines of the index files.
NOTES = (
    "## Ingestion Notes for AI Agents",
    "",
    "- Standard: [llms.txt](https://llmstxt.org/) format for automated AI context ingestion.",
    "- For full comprehensive corpus, consult `llms-full.txt`.",
    "- For vector databases and embeddings, consult `rag-chunks.jsonl` (embed `embedding_text`, inject `text`).",
)
WHOLE = "- Recommended: the full corpus is ~{n} tokens, load `llms-full.txt` entirely (with prompt caching) instead of retrieving chunks."
PARTS = "- Recommended: the full corpus is ~{n} tokens, use `rag-chunks.jsonl` with hybrid search (embeddings + BM25) and reranking."
WHY_WHOLE = "Corpus de {n} tokens (< {m}) : chargez llms-full.txt en entier avec le prompt caching, un RAG n'apporterait que de la perte de rappel."
WHY_PARTS = "Corpus de {n} tokens (> {m}) : indexez rag-chunks.jsonl (embedding_text) en recherche hybride embeddings + BM25, puis reranking."
EMPTY = "- No documents available in this knowledge base."
KEYWORDS, OUTLINE, SUMMARY = 20, 6, 160
#: Rows of a family that one task folds over; larger families get the same names by ranges.
FAMILY = 50_000
#: Rows are counted by ranges of so many values of what orders them.
RANGE = 10_000
#: What encodeURI leaves alone besides letters and digits.
URI_SAFE = ";,/?:@&=+$-_.!~*'()#"


@arrow_udf(StringType())
def encode_uri(path):
    import pyarrow as pa

    return pa.array([None if p is None else quote(p, safe=URI_SAFE) for p in path.to_pylist()], type=pa.string())


def convert(files: DataFrame, options: Options = Options()) -> DataFrame:
    """SRC-02, SRC-03, API-03: rows (ord, path, content) with format, markdown, pages, warnings and error added.

    A file that can't be converted is a row with an error; the others go on.
    """
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.col("mimetype") if "mimetype" in files.columns else None
    return files.withColumn("filename", name).withColumn("_c", stages.convert(F.col("content"), name, kind, options)).select("*", "_c.*").drop("content", "_c")


def process(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """KB-01: documents (ord, filename, markdown) anonymised, optimised, counted and chunked.

    Rows without filename or markdown are left out (SRC-05). Columns out: ord, original_filename, filename, doc_id, raw,
    markdown, body, meta, savings, stats, chunks, entities, entity_counts, originals. What isn't selected isn't computed.
    """
    given = docs.filter("filename is not null and markdown is not null").select("ord", F.col("filename").alias("original_filename"), F.col("markdown").alias("raw"))
    stem = native.stem(F.col("original_filename"))
    named = given.withColumn("filename", F.concat(stem, F.lit(".md"))).withColumn("doc_id", native.doc_key(stem))
    if options.anonymize:
        named = named.withColumn("_a", stages.anonymize(F.col("raw"), options.anonymize_mode, options.off))
        clean = named.select("*", F.col("_a.text").alias("_text"), F.col("_a.entities").alias("entities"), F.col("_a.by_type").alias("entity_counts"), F.col("_a.originals").alias("originals")).drop("_a")
    else:
        none = "cast(null as array<struct<type: string, original: string, placeholder: string>>)"
        clean = named.selectExpr("*", "raw as _text", f"{none} as entities", "cast(null as map<string, bigint>) as entity_counts", "cast(null as map<string, string>) as originals")
    done = clean.withColumn("_o", stages.optimize_counted(F.col("_text"), F.col("filename"), options)).select("*", "_o.*").drop("_o", "_text")
    rest = [F.col(f"_s.{f}").alias(f) for f in ("encoding", "legacy_tokens", "words", "chars", "tokens_per_word", "estimated_costs")]
    done = done.withColumn("_s", stages.analyze(F.col("markdown"))).withColumn("stats", F.struct("tokens", *rest)).drop("_s", "tokens")
    if options.include_chunks:
        title = F.when(F.col("meta.title") != "", F.col("meta.title")).otherwise(native.stem(F.col("original_filename")))
        done = done.withColumn("chunks", stages.chunk(F.col("body"), F.col("doc_id"), title, options))
    return done


def chunks_of(processed: DataFrame) -> DataFrame:
    """KB-05: one row a chunk, ordered by (ord, chunk_index)."""
    return processed.select("ord", F.explode("chunks").alias("_c")).select("ord", "_c.*")


def _running(rows: DataFrame, order: str, *ties: Column) -> DataFrame:
    """rows (key, w and others) with _sum, the sum of w up to each row of its key in the given order; counted by ranges of it."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / RANGE))
    counts = ranged.groupBy("key", "_range").agg(F.sum("w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("w").over(Window.partitionBy("key", "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_within", within).join(counts.select("key", "_range", before.alias("_before")), ["key", "_range"])
    return summed.withColumn("_sum", F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def _first_free(rows: DataFrame) -> DataFrame:
    """(ord, filename) of rows (ord, filename, _family), named as one fold over a family in order of ord names them.

    A name x-n.md can only be taken by the claimants of x.md, which are its second and later bearers, or all of them if x.md
    itself was taken. The i-th claimant gets the i-th number from 2 that isn't kept by a given name. A given x-n.md keeps its
    own if it comes before the claimant who would get there, for which the bearers of x.md before it say enough. So one task
    folds over the distinct numbered names of a family whose x.md is given as well, and all rows are numbered by ranges.
    """
    stem = F.regexp_replace("filename", r"\.md\z", "")
    firsts = rows.groupBy("_family", "filename").agg(F.min("ord").alias("ord"))
    number = F.regexp_extract(stem, r"-([2-9]|[1-9][0-9]{1,17})\z", 1)
    children = firsts.select("_family", F.col("filename").alias("child"), "ord", number.alias("_number"), F.concat(F.regexp_replace(stem, r"-[0-9]+\z", ""), F.lit(".md")).alias("key"))
    children = children.filter("_number <> ''").withColumn("number", F.col("_number").cast("long")).join(firsts.select(F.col("filename").alias("key")), "key", "left_semi")
    given = rows.select("_family", F.col("filename").alias("key"), "ord", F.lit(1).alias("w"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("number"))
    placed = _running(given.unionByName(children.select("_family", "key", "ord", F.lit(0).alias("w"), "child", "number")), "ord", F.col("w"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, bool] = {}
        out = []
        for key, part in sorted(pdf.groupby("key"), key=lambda g: len(g[0])):  # x before x-n
            passed = 0
            for child, n, bearers in part.sort_values("number")[["child", "number", "bearers"]].itertuples(index=False):
                claimants = max(0, bearers - 1) if kept.get(key, True) else bearers
                kept[child] = n - 1 - passed > claimants
                out.append((key, child, kept[child], n - 1 - passed))
                passed += kept[child]
        return pd.DataFrame(out, columns=["key", "child", "kept", "at"])

    marks = placed.filter("w = 0").select("_family", "key", "child", "number", F.col("_sum").alias("bearers"))
    decided = reliable(marks.groupBy("_family").applyInPandas(decide, "key string, child string, kept boolean, at long"))
    own = decided.select(F.col("child").alias("key"), "kept")
    ranked = placed.filter("w = 1").select("key", "ord", F.col("_sum").alias("_place")).join(own, "key", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    claims = ranked.select("key", "ord", F.when(F.col("kept"), F.col("_place") - 1).otherwise(F.col("_place")).alias("at"), F.lit(0).cast("long").alias("w"))
    stops = decided.filter("kept").groupBy("key", "at").agg(F.count("*").alias("w"))
    numbered = _running(claims.filter("at > 0").unionByName(stops, allowMissingColumns=True), "at", F.desc("w")).filter("w = 0")
    new = F.concat(F.regexp_replace("key", r"\.md\z", ""), F.lit("-"), (F.col("at") + 1 + F.col("_sum")).cast("string"), F.lit(".md"))
    return claims.filter("at = 0").select("ord", F.col("key").alias("filename")).unionByName(numbered.select("ord", new.alias("filename")))


def distinct_names(docs: DataFrame, most: int | None = None) -> DataFrame:
    """KB-03: filename made unique in order of ord: x.md, x-2.md, ..., the first that is free, at any size.

    Names that could collide share a family, their stem without trailing -numbers. Where no name of a family comes twice all
    are kept. One task folds over the names of a family of up to FAMILY rows, or of one with names that don't end in .md, and
    over many families one after the other; larger ones get the same names by ranges. Only if `most`
    is given, the second and later bearers of a name in a family of over `most` rows get numbers past all numbers in the
    family's names: unique as well, but not the first free ones.
    """
    stem = F.regexp_replace("filename", r"\.md$", "")
    given = reliable(docs.select("ord", "filename")) if most is None else docs  # so that docs is read once for all steps
    named = given.select("ord", "filename", F.regexp_replace(stem, r"(-[0-9]+)+$", "").alias("_family"))
    last = F.regexp_extract(stem, r"-([0-9]{1,9})$", 1)
    top = F.max(F.when(last != "", last.cast("long")).otherwise(F.lit(0).cast("long")))
    times = named.groupBy("_family", "filename").agg(F.count("*").alias("_n"), top.alias("_top"))
    sizes = times.groupBy("_family").agg(F.sum("_n").alias("_size"), F.max("_n").alias("_most"), F.max("_top").alias("_top"), F.bool_and(F.col("filename").endswith(".md")).alias("_md"))
    sized = named.join(sizes, "_family")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come family by family, each in order of ord; only the names of the family at hand are kept."""
        family: str | None = None
        used: set[str] = set()
        free: dict[str, int] = {}
        for pdf in batches:
            out = []
            for name, its in zip(pdf["filename"], pdf["_family"]):
                if its != family:
                    family, used, free = its, set(), {}
                new, n = name, free.get(name, 2)
                while new in used:
                    new = f"{name.removesuffix('.md')}-{n}.md"
                    n += 1
                free[name] = n
                used.add(new)
                out.append(new)
            yield pd.DataFrame({"ord": pdf["ord"], "filename": out})

    folds = (F.col("_size") <= FAMILY) | ~F.col("_md") if most is None else F.col("_size") <= most
    in_turn = sized.filter(folds & (F.col("_most") > 1)).select("ord", "filename", "_family").repartition("_family").sortWithinPartitions("_family", "ord")
    folded = in_turn.mapInPandas(fold, f"ord {dict(docs.dtypes)['ord']}, filename string")
    small = sized.filter(folds & (F.col("_most") == 1)).select("ord", "filename").unionByName(folded)
    if most is None:
        rest = sized.filter(~folds).select("ord", "filename", "_family")
        return docs.drop("filename").join(small if rest.isEmpty() else small.unionByName(_first_free(rest)), "ord")
    large = sized.filter(~folds).withColumn("_range", F.floor(F.col("ord") / 10_000))
    counts = large.groupBy("filename", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("filename").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("filename", "_range").orderBy("ord")) + F.col("_before")
    placed = large.join(counts.select("filename", "_range", before.alias("_before")), ["filename", "_range"]).withColumn("_place", place)
    new = F.concat(F.regexp_replace("filename", r"\.md$", ""), F.lit("-"), (F.col("_top") + F.col("_place")).cast("string"), F.lit(".md"))
    numbered = placed.select("ord", F.when(F.col("_place") == 1, F.col("filename")).otherwise(new).alias("filename"))
    return docs.drop("filename").join(small.unionByName(numbered), "ord")


def strategy(total: int) -> dict:
    """KB-06: whole up to MOST_IN_CONTEXT tokens, retrieval beyond."""
    whole = total <= MOST_IN_CONTEXT
    return {
        "strategy": "full_context" if whole else "rag",
        "total_tokens": total,
        "threshold_tokens": MOST_IN_CONTEXT,
        "file": "llms-full.txt" if whole else "rag-chunks.jsonl",
        "rationale": (WHY_WHOLE if whole else WHY_PARTS).format(n=total, m=MOST_IN_CONTEXT),
    }


def title_column() -> Column:
    return F.when(F.col("meta.title") != "", F.col("meta.title")).otherwise(F.col("filename"))


def index_lines(processed: DataFrame, base: str = "docs/") -> DataFrame:
    """KB-08: (ord, line), a link with description and tokens for each document."""
    title = F.regexp_replace(title_column(), r"[\[\]]", "")
    described = F.when(F.col("meta.description") != "", F.col("meta.description")).otherwise("Reference documentation.")
    path = F.when(F.col("filename").endswith(".md"), F.col("filename")).otherwise(F.concat("filename", F.lit(".md")))
    text = F.substring(F.regexp_replace(described, "[\\r\\n]+", " "), 1, SUMMARY)
    line = F.concat(F.lit("- ["), title, F.lit(f"]({base}"), encode_uri(path), F.lit("): "), text, F.lit(" (Tokens: ~"), F.col("stats.tokens").cast("string"), F.lit(")"))
    return processed.select("ord", line.alias("line"))


def first_keywords(processed: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """The first distinct keywords in order of the documents: (keyword, ord, at)."""
    placed = processed.select("ord", F.posexplode("meta.keywords").alias("at", "keyword"))
    return placed.groupBy("keyword").agg(F.min(F.struct("ord", "at")).alias("_first")).orderBy("_first").limit(most).select("keyword", "_first.ord", "_first.at")


def full_blocks(processed: DataFrame) -> DataFrame:
    """KB-09: (ord, before, block), a document's part of llms-full.txt around its number."""
    head = F.concat(F.lit(": "), title_column(), F.lit("\n*Source: "), F.col("filename"), F.lit(" | Tokens: ~"), F.col("stats.tokens").cast("string"), F.lit("*\n\n"))
    return processed.select("ord", F.lit("## Document ").alias("before"), F.concat(head, native.trim(F.col("markdown")), F.lit("\n\n---\n")).alias("block"))


def small_blocks(processed: DataFrame) -> DataFrame:
    """KB-10: (ord, before, block), a document's part of llms-small.txt around its number."""
    described = F.when(F.col("meta.description") != "", F.concat(F.lit("> "), F.col("meta.description"), F.lit("\n"))).otherwise("")
    outline = F.transform(F.slice("meta.headings", 1, OUTLINE), lambda h: F.concat(F.lit("  - "), h["text"], F.lit("\n")))
    listed = F.when(F.size("meta.headings") > 0, F.concat(F.lit("Key sections:\n"), F.array_join(outline, ""))).otherwise("")
    return processed.select("ord", F.lit("### ").alias("before"), F.concat(F.lit(". "), title_column(), F.lit("\n"), described, listed).alias("block"))


@dataclass
class KnowledgeBase:
    """DataFrames of a knowledge base: documents and chunks by row, the texts of the index files as ordered lines."""

    documents: DataFrame
    chunks: DataFrame
    manifest: DataFrame
    lines: DataFrame
    total_tokens: int


def totals(processed: DataFrame) -> DataFrame:
    """KB-04: one row of sums over the documents."""
    entities = F.coalesce(F.size("entities"), F.lit(0))
    out = processed.agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.sum("savings.original_tokens"), F.lit(0)).alias("total_original_tokens"),
        F.coalesce(F.sum("savings.optimized_tokens"), F.lit(0)).alias("total_optimized_tokens"),
        F.coalesce(F.sum(F.when(F.col("entities").isNotNull(), entities).otherwise(0)), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("total_chunks"),
    )
    saved = F.greatest(F.lit(0), F.col("total_original_tokens") - F.col("total_optimized_tokens"))
    return out.withColumn("tokens_saved", saved).withColumn("savings_percentage", native.savings_percentage(saved, F.col("total_original_tokens")))


def build(docs: DataFrame, options: Options = Options()) -> KnowledgeBase:
    """KB-13: the knowledge base of documents (ord, filename, markdown); frontmatter and chunks always.

    The processed documents are written once, since all index files read them. total_tokens is the sum over the blocks
    of llms-full.txt with their heads, each counted by itself: a text that has to be one cell doesn't grow with the corpus.
    """
    options = Options(**{**options.__dict__, "inject_frontmatter": True, "include_chunks": True})
    processed = reliable(distinct_names(process(docs, options)).drop("raw"))
    full = ranked(full_blocks(processed))
    heading = f"# {options.title}\n\n> {options.summary}\n\n---\n"
    total = full.agg(F.sum(stages.count_tokens(F.col("line"))).alias("n")).first()["n"] or 0
    total += tokens.count_tokens(heading)
    plan = strategy(int(total))
    spark = docs.sparkSession
    index = index_lines(processed)
    words = [r["keyword"] for r in first_keywords(processed).collect()]  # KEYWORDS at most
    some = processed.limit(1).count() > 0
    head = [f"# {options.title}", "", f"> {options.summary}", "", "## Documentation & Knowledge Files", "", *([] if some else [EMPTY])]
    tail = ["", "## Topics & Key Concepts", "", *([f"Keywords: {', '.join(words)}", ""] if words else []), *NOTES, (WHOLE if plan["strategy"] == "full_context" else PARTS).format(n=total)] if some else []
    small = [f"# {options.title}", "", f"> {options.summary}", "", "## Executive Summary of Documents", ""]
    fixed = [("llms.txt", 0, i, x) for i, x in enumerate(head)] + [("llms.txt", 2, i, x) for i, x in enumerate(tail)]
    fixed += [("llms-full.txt", 0, 0, heading)] + [("llms-small.txt", 0, i, x) for i, x in enumerate(small)]
    lines = spark.createDataFrame(fixed, "file string, section int, number long, line string")
    body = ranked(index).select(F.lit("llms.txt").alias("file"), F.lit(1).alias("section"), "number", "line")
    body = body.unionByName(full.select(F.lit("llms-full.txt").alias("file"), F.lit(1).alias("section"), "number", "line"))
    body = body.unionByName(ranked(small_blocks(processed)).select(F.lit("llms-small.txt").alias("file"), F.lit(1).alias("section"), "number", "line"))
    facts = totals(processed).select(
        F.lit(options.title).alias("title"), F.lit(options.summary).alias("summary"), F.lit(options.level).alias("optimization_level"), "*",
        F.struct(*[F.lit(v).alias(k) for k, v in plan.items()]).alias("context_strategy"), F.lit(tokens.encoder()[0]).alias("encoding"),
    )
    return KnowledgeBase(processed, chunks_of(processed), facts, lines.unionByName(body), int(total))


def file_rows(processed: DataFrame) -> DataFrame:
    """KB-11: the rows of the manifest's list of files."""
    n = F.when(F.col("entities").isNotNull(), F.size("entities")).otherwise(0)
    return processed.select("ord", "filename", "original_filename", F.col("meta.title").alias("title"), F.col("stats.tokens").alias("tokens"), F.col("savings.savings_percentage").alias("savings"), n.alias("anonymized_count"))


def batch_economy(converted: DataFrame) -> DataFrame:
    """KB-12: tokens before (bodies) and after (final Markdown) over the documents that were converted."""
    out = converted.agg(F.sum("savings.original_tokens").alias("original_tokens"), F.sum("stats.tokens").alias("optimized_tokens"))
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens"))
    return out.withColumn("tokens_saved", saved).withColumn("savings_percentage", native.savings_percentage(saved, F.col("original_tokens")))


def ranked(blocks: DataFrame) -> DataFrame:
    """(number, line) from (ord, line) or (ord, before, block): numbers from 1 in order of ord, put between before and block.

    The places are found from ord alone, by ranges of equally many rows (readers.placed): any values of ord will do, no task
    holds all rows, and the texts move only where there are too many places to broadcast.
    """
    places = readers.placed(blocks.select("ord"), "ord")
    some = places.limit(readers.BROADCAST_PATHS + 1).count() <= readers.BROADCAST_PATHS
    joined = blocks.join(F.broadcast(places) if some else places, "ord")
    number = (F.col("place") + 1).cast("long")
    line = F.concat("before", number.cast("string"), "block") if "block" in blocks.columns else F.col("line")
    return joined.select(number.alias("number"), line.alias("line"))


def capabilities(spark: SparkSession) -> DataFrame:
    """API-10: formats, levels, modes and prices, one row."""
    from ..functions import files, markdown, pii, sheets

    prices = [(m["id"], m["label"], m["provider"], float(m["inputPerMillion"])) for m in tokens.load_pricing()]
    row = ([f for f, _, _ in files.FORMATS] + ["text"], list(markdown.LEVELS), list(pii.MODES), list(sheets.FORMATS), tokens.encoder()[0], prices)
    return spark.createDataFrame([row], "formats array<string>, levels array<string>, modes array<string>, table_formats array<string>, encoding string, pricing array<struct<id: string, label: string, provider: string, input_per_million: double>>")
