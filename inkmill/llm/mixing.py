"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, guarded, read, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: Seeds that are tried for each source; the one whose draws come nearest to the target is used, the first of equally near ones.
#: So a source's draw depends on all its documents, and a new one can change which are doubled; with one seed it can't.
SEEDS = 16
#: Up to so many sources (about 100 bytes each) the rates are broadcast; beyond it they join by a shuffle.
BROADCAST_SOURCES = 10_000


def draw(key: Column, seed: Column) -> Column:
    """A uniform number in [0, 1) from a hash: the same in every run, and computable by any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(seed, F.lit(":"), key)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def measured(docs: DataFrame) -> DataFrame:
    """docs with size, its words, and _key, what its draw is made from: doc_id, or the text's hash where that is null."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.drop("size", "_key").withColumn("size", word_count(F.col("text"))).withColumn("_key", key)


def source_rates(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target and rate = target / source_size.

    Raising one level until no target is over its limit is resharing the excess by weight. With sources in order of limit
    per weight, the level is (words left) / (weight left) at the first source that stays under its own limit, so two windows
    over the few rows of the sources settle what would else be a loop.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = by.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    choice = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("_w", choice).withColumn("_limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("_limit") / F.col("_w"), "_rank")
    every = Window.partitionBy()
    filled = F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    level = limited.withColumn("_level", (total - filled).cast("double") / left.cast("double"))
    under = F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.col("_level"))
    settled = level.withColumn("_under", under).withColumn("_settled", F.max("_under").over(every))
    target = F.least(F.col("_limit").cast("double"), F.col("_settled") * F.col("_w"))
    out = settled.withColumn("target", F.coalesce(target, F.col("_limit").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def _small(rates: DataFrame) -> DataFrame:
    return F.broadcast(rates) if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rates


def _with(docs: DataFrame, rates: DataFrame) -> DataFrame:
    named = rates.withColumnRenamed("source", "_source")
    return docs.join(_small(named), docs["source"].eqNullSafe(named["_source"]), "left").drop("_source")


def plan(sized: DataFrame, weights=WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """Per source: source, source_size, target, rate and seed, from measured documents (source, size, _key)."""
    rates = cut(source_rates(sized.select("source", "size"), weights, most))
    rows = _with(sized.select("source", "size", "_key"), rates)
    extra = F.col("rate") - F.floor("rate")
    tries = [F.sum(F.when(draw(F.col("_key"), F.lit(f"mix{k}")) < extra, F.col("size")).otherwise(0)).alias(f"_t{k}") for k in range(seeds)]
    summed = rows.groupBy("source", "source_size", "target", "rate").agg(*tries)
    off = [F.struct(F.abs(F.col(f"_t{k}") + F.floor("rate") * F.col("source_size") - F.col("target")).alias("d"), F.lit(k).alias("k")) for k in range(seeds)]
    return cut(summed.select("source", "source_size", "target", "rate", F.concat(F.lit("mix"), F.array_min(F.array(*off))["k"].cast("string")).alias("seed")))


def mix(keyed: DataFrame, rates: DataFrame) -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the document) to documents with _key, by a plan.

    copies = floor(rate) plus one with probability rate - floor(rate), drawn from a hash of the document and its source's
    seed. Sizes are words; null and empty texts have none and a source of only such texts gets rate 0. Null sources are one
    source, last in order. A text of any length counts whole and is taken whole; no rows give no rows. Rows with one doc_id share a draw, so repeated rows are taken equally often. Other columns pass
    through unless they bear a name made here, which replaces it. Only per-source sums are shuffled: hot sources are
    aggregated in part before, and the join sends the rates to the documents.
    """
    joined = _with(keyed.drop("source_size", "target", "rate", "copies", "seed", "_source"), rates)
    more = (draw(F.col("_key"), F.col("seed")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate").cast("long") + more).drop("rate", "seed", "_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs. Words are counted once."""
    made = ("size", "source_size", "target", "rate", "seed", "copies", "_key", "_source", "_copy")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))

    def taken(d: DataFrame) -> DataFrame:
        keyed = measured(d)
        rates = plan(cut(keyed.select("source", "size", "_key")), **options)
        return mix(keyed.drop("size"), rates).filter("copies > 0").withColumn("_copy", copies)

    return guarded(docs, made, taken)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(measured(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "_key"))  # the texts are read once
    return mix(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM by_source
), weighed AS (
  SELECT *, CAST(CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, source_size * 3 AS lim FROM ranked
), levels AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY lim / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM weighed
), settled AS (
  SELECT *, max(CASE WHEN lev * w <= lim THEN lev END) OVER () AS top FROM levels
), rates AS (
  SELECT source, source_size, coalesce(least(CAST(lim AS DOUBLE), top * w), CAST(lim AS DOUBLE)) AS target FROM settled
), keyed AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    coalesce(CAST(d.doc_id AS VARCHAR), 't' || md5(coalesce(d.text, ''))) AS key
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), tried AS (
  SELECT k.*, s.seed, CAST(('0x' || substr(md5('mix' || s.seed || ':' || key), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM keyed k, range(16) s(seed)
), sums AS (
  SELECT source, seed, abs(sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) + floor(any_value(rate)) * any_value(source_size) - any_value(target)) AS off
  FROM tried GROUP BY source, seed
), best AS (
  SELECT source, seed, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS place FROM sums
)
SELECT t.doc_id, t.size, t.source_size, t.target,
  CAST(t.size * (floor(t.rate) + CASE WHEN t.u < t.rate - floor(t.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM tried t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.seed = b.seed AND b.place = 1
"""
