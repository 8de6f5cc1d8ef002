"""A pipeline over documents in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import common, lines, mixing, ngrams, packing, toxicity
from inkmill.ship import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; null and empty texts stay."""
    ship(spark)
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return common.guarded(docs, ("score", "spans"), lambda d: toxicity.score(d, model).filter(F.col("score") < toxicity.THRESHOLD))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that many sites share; n_chars follows the text."""
    ship(spark)

    def strip(d: DataFrame) -> DataFrame:
        out = lines.strip_shared_lines(d)
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", changed) if "n_chars" in d.columns else out

    return common.guarded(docs, lines.MADE, strip)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; repeated rows of a doc_id and text are one.

    Rows of one doc_id with different texts are judged by text.
    """
    ship(spark)
    names = docs.columns
    judged = common.cut(ngrams.near_duplicates(docs, with_hash=True).filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n")).filter("not _kept or _n > 1"))
    gone = common.few(judged.filter("not _kept").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")), ngrams.BROADCAST_IDS)
    again = common.few(judged.filter("_kept").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")), ngrams.BROADCAST_IDS)
    same = (F.col("doc_id") == F.col("_near_id")) & (F.xxhash64("text") == F.col("_near_hash"))
    left = docs.join(gone, same, "left_anti")
    if judged.filter("_kept").isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in names])
    repeated = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(repeated).select(*[F.col(f"`{c}`") for c in names])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs.

    Null and empty texts have no words: a source of only such texts is taken not at all, others take them as their other
    documents. A null source is a source; rows of one doc_id are taken equally often; long texts are taken whole.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed: doc_id, piece, size, bin, start.

    Null and empty texts are one piece of no words; texts over a bin are cut into pieces. The copies that the mix made are
    equal texts, so no two share a bin. Null ids and sources, repeated rows and ties pack as packing.pack says.
    """
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The toxicity and packing stages can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage's table is deleted when the next one's is written; of a failed run nothing stays."""
    docs = common.read(spark, sf_dir, "documents")
    path = None
    for name, stage in STAGES:
        before, path = path, common.new_path(spark, name)
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            common.drop_path(spark, path)
            raise
        finally:
            if before:
                common.drop_path(spark, before)
        docs = spark.read.parquet(path)
    return docs
