"""Functions for SQL: register(spark) makes them callable by name in any query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from .functions import chunks, html, markdown, pii, tokens


class ChunkMarkdown:
    """Table function chunk_markdown(text, doc_id, title, max_tokens): a row a chunk."""

    def eval(self, text: str, doc_id: str, title: str, most: int) -> Iterator[tuple]:
        for c in chunks.chunk(text, doc_id, title or "Document", most):
            yield c["chunk_index"], c["id"], c["title"], " > ".join(c["breadcrumbs"]), c["token_count"], c["content"]


#: Scalar functions and their types; each is called batch by batch.
FUNCTIONS = {
    "count_tokens": (tokens.count_tokens, "bigint"),
    "html_to_markdown": (html.to_markdown, "string"),
    "optimize_markdown": (lambda t, level: markdown.optimize(t, level)["markdown"], "string"),
    "anonymize_text": (lambda t, mode: pii.anonymize(t, mode)["text"], "string"),
}


def _batched(function, kind: str):
    arrow = {"bigint": pa.int64(), "string": pa.string()}[kind]

    def one(text: pa.Array) -> pa.Array:
        return pa.array(map(function, text.to_pylist()), type=arrow)

    def two(text: pa.Array, choice: pa.Array) -> pa.Array:
        return pa.array(map(function, text.to_pylist(), choice.to_pylist()), type=arrow)

    return two if function.__code__.co_argcount == 2 and function.__name__ == "<lambda>" else one


def register(spark: SparkSession) -> None:
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, arrow_udf(_batched(function, kind), kind))
    spark.udtf.register("chunk_markdown", udtf(ChunkMarkdown, returnType="chunk_index int, id string, title string, breadcrumbs string, token_count bigint, content string"))
