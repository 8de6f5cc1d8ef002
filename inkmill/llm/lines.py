"""Removing lines that many sites share: HyperLogLog sketches of sites, exact counts near the threshold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import cut, read

#: A line on at least so many distinct sites is boilerplate.
SITES = 5
#: log2 of a sketch's registers: a relative standard error of about 1.6 %.
LG_K = 12
#: Estimates within so much of the threshold, relatively and absolutely, get an exact count.
BAND, SLACK = 0.1, 1.0
#: Up to so many hashes of lines (under 50 bytes each) are broadcast to the lines; beyond it the lines are shuffled to them.
BROADCAST_LINES = 100_000
#: Columns that are made on the way.
MADE = ("n_lines", "n_removed", "_text", "_k1", "_k2", "_drop")
#: What names a line: 128 bits of hash, so that no two lines of a corpus are taken for one.
NAME = ["line", "line2"]


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, at, line, line2, site) for every line that isn't blank. k1 and k2 name the document, line and line2 the line."""
    cut_up = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.coalesce("source", F.lit("")).alias("site"), F.split("text", "\n").alias("_lines"))
    exploded = cut_up.select("k1", "k2", "site", F.posexplode("_lines").alias("at", "_line"))  # the text itself isn't copied to its lines
    bare = exploded.withColumn("_bare", F.trim("_line", F.lit(" \t\x0b\x0c\r"))).filter("_bare <> ''")
    return bare.select("k1", "k2", "at", F.xxhash64("_bare").alias("line"), F.xxhash64(F.lit(1), "_bare", F.octet_length("_bare")).alias("line2"), "site")


@pandas_udf(StringType())
def without(text: pd.Series, drop: pd.Series) -> pd.Series:
    """The text without the lines at the positions in drop."""
    out = []
    for whole, at in zip(text, drop):
        if at is None or whole is None:
            out.append(whole)
        else:
            gone = set(at.tolist())
            out.append("\n".join(line for i, line in enumerate(whole.split("\n")) if i not in gone))
    return pd.Series(out, index=text.index, dtype=object)


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; it is read twice, so it should be a checkpoint."""
    return F.broadcast(df) if df.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else df


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(line, line2, holder1, holder2) of the lines on at least `sites` distinct sites; the holder is the first document with it.

    Sketches of each line merge by partial aggregation, so a line in a third of all documents arrives as a sketch a task.
    Estimates clear of the threshold decide; the others are counted exactly, by a distinct (line, site) before the count.
    """
    first = F.min(F.struct("k1", "k2")).alias("holder")
    sketched = lines.groupBy(*NAME).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("near"), first, F.count("*").alias("_n"))
    low, high = sites * (1 - BAND) - SLACK, sites * (1 + BAND) + SLACK
    judged = cut(sketched.filter((F.col("_n") >= sites) & (F.col("near") >= low)))
    doubtful = judged.filter(F.col("near") <= high)
    exact = lines.select(*NAME, "site").join(_few(doubtful.select(*NAME)), NAME, "left_semi").distinct().groupBy(*NAME).agg(F.count("*").alias("_sites"))
    sure = judged.filter(F.col("near") > high).select(*NAME, "holder")
    near = doubtful.join(exact.filter(F.col("_sites") >= sites), NAME).select(*NAME, "holder")
    return sure.unionByName(near).select(*NAME, F.col("holder.k1").alias("holder1"), F.col("holder.k2").alias("holder2"))


def strip_shared_lines(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with cross-site boilerplate lines removed from text, and the columns n_lines and n_removed added
    (they and the other names in MADE replace columns of docs).

    Lines are \\n-separated and equal when they are so without white space at their ends; blank ones never go. A site is a
    source; null counts as the site ''. A line on `sites` sites or more stays in its first document (smallest doc_id, nulls
    first, then text hash) and goes from all others, so content that is shared whole survives once. All rows stay: a null
    text stays null with no lines, an empty one has one blank line, a document of boilerplate alone becomes ''. Repeated rows
    of one doc_id and text are one document; no rows give no rows. A text of any length is split by the engine and its lines
    are hashed one by one; only its own row holds it. Hot lines join as skewed joins do; only positions of removed lines travel with
    the text, once.
    """
    docs = docs.drop(*MADE)
    lines = _lines(docs)
    shared = _few(cut(boilerplate(lines, sites, lg_k)))
    gone = lines.join(shared, NAME).filter(~(F.col("k1").eqNullSafe(F.col("holder1")) & (F.col("k2") == F.col("holder2"))))
    drop = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("_drop")).withColumnRenamed("k1", "_k1").withColumnRenamed("k2", "_k2")
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    joined = keyed.join(drop, keyed["doc_id"].eqNullSafe(drop["_k1"]) & (keyed["_text"] == drop["_k2"]), "left")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    n_removed = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop"))
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed", n_removed.cast("long"))
    return out.withColumn("text", without("text", "_drop")).drop("_text", "_k1", "_k2", "_drop")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), bare AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM lines
), shared AS (
  SELECT line, min(doc_id) AS holder FROM bare WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
), judged AS (
  SELECT b.doc_id, b.pos, b.raw, s.line IS NOT NULL AND b.doc_id <> s.holder AS gone
  FROM bare b LEFT JOIN shared s ON b.line = s.line
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM judged GROUP BY doc_id
"""
