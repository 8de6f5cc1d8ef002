"""Relational rows as Markdown sheets with DataFrame functions. CONV-10 to CONV-18."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import trim
from ..functions.sheets import MAX_ROWS
from ..sources.readers import placed


def _clean(cell: Column) -> Column:
    return F.regexp_replace(F.replace(trim(cell), F.lit("|"), F.lit("\\|")), "\\r?\\n", " ")


def sheet_rows(rows: DataFrame, heads: list[str], style: str = "compact", max_rows: int | None = MAX_ROWS) -> DataFrame:
    """(row_no, line) of a sheet (row_no, cells array<string>): heads, data rows numbered from 1, a note if some are left out.

    Blank rows are skipped before numbering. Only the first max_rows rows by row_no are numbered: a distributed top-k finds
    them, so nothing grows with the sheet. With max_rows None all rows are, by ranges, so no task holds the sheet.
    """
    width = len(heads)
    names = [h.strip().replace("|", "\\|") or f"Col_{i}" for i, h in enumerate(heads, 1)]
    kept = rows.filter(F.exists("cells", lambda c: trim(c) != ""))
    if max_rows is None:
        shown = placed(kept.select("row_no", "cells"), "row_no").select((F.col("place") + 1).cast("long").alias("row_no"), "cells")
    else:
        first = kept.orderBy("row_no").limit(max_rows)
        shown = first.select(F.row_number().over(Window.orderBy("row_no")).cast("long").alias("row_no"), "cells")
    at = [F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")) for i in range(width)]
    if style == "records":
        parts = F.filter(F.array(*[F.when(trim(c) != "", F.concat(F.lit(f"**{n}**: "), trim(c))) for n, c in zip(names, at)]), lambda p: p.isNotNull())
        lines = shown.select("row_no", F.concat(F.lit("- [Ligne "), F.col("row_no").cast("string"), F.lit("] "), F.array_join(parts, " | ")).alias("line"))
        out = lines
    else:
        left, mid, right = ("|", "|", "|") if style == "compact" else ("| ", " | ", " |")
        lines = shown.select("row_no", F.concat(F.lit(left), F.array_join(F.array(*map(_clean, at)), mid), F.lit(right)).alias("line"))
        spark = rows.sparkSession
        head = spark.range(1).select(F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("row_no"), F.lit(left + mid.join(names) + right).alias("line")),
            F.struct(F.lit(0).cast("long").alias("row_no"), F.lit(left + mid.join(["---"] * width) + right).alias("line")),
        )).alias("_r")).select("_r.*")
        out = head.unionByName(lines)
    if max_rows is None:
        return out
    rest = kept.agg((F.count("*") - max_rows).alias("_more")).filter("_more > 0")
    note = rest.select(F.lit(max_rows + 1).cast("long").alias("row_no"), F.concat(F.lit("> ⚠️ *Table tronquée: "), F.col("_more").cast("string"), F.lit(" lignes supplémentaires omises pour optimiser les tokens LLM.*")).alias("line"))
    return out.unionByName(note)
