"""Sources: files of any format, tables of texts, and relational tables as sheets. SRC-02 to SRC-05, SRC-08."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import files

#: A scan of at least so many splits a core isn't looked at: it keeps all cores busy.
SPLITS = 16


#: Rows of a task that runs Python over texts: its time and its batches don't grow with the table.
TASK_ROWS = 2_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table whose file layout leaves cores idle, dealt evenly to them; any other as it is.

    A Parquet file is read by as many tasks as it has row groups, however many splits it is cut into, so the splits that hold
    rows are counted (from the footers, no column is read). The rule looks at the layout and at no size, unless `rows` says
    how many a task should have: then a table is dealt as well where a split holds over four times as many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is None and df.rdd.getNumPartitions() >= SPLITS * cores:
        return df
    splits = df.groupBy(F.spark_partition_id().alias("_p")).count().agg(F.count("*").alias("busy"), F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    if splits["busy"] >= cores and (rows is None or splits["largest"] <= 4 * rows):
        return df
    return df.repartition(max(cores, -(-(splits["rows"] or 0) // rows) if rows else 0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a temporary one only where they are one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkmill-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh() -> str:
    return uuid.uuid4().hex


def reliable(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Unlike a checkpoint it is compressed, and a reader of a few columns reads those alone. The caller's cluster clears the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/kb-{fresh()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(keys: DataFrame, order: str) -> DataFrame:
    """keys with `place`, their position from 0 by the column `order`, whose values should be distinct.

    Rows are dealt to ranges that hold about as many each, whatever the values are, and sorted within; the ranges' counts (a
    row a partition) give each its first place. So no task holds all rows and none depends on how the values are spread.
    """
    ranges = keys.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    kept = reliable(ranges)
    counts = kept.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", (before - F.col("_first")).alias("_before"))
    return kept.join(F.broadcast(starts), "_p").select(*keys.columns, (F.col("_i") + F.col("_before")).alias("place"))


#: Up to so many paths (under 300 bytes each) are broadcast to their files; beyond it they join by a shuffle.
BROADCAST_PATHS = 100_000


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files under a path as rows (ord, path, content, length); ord is their place by path, from 0. Files over the limit keep no content.

    The places are found from the paths alone; no content is read or moved for it while the paths are few.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    content = F.when(F.col("length") <= files.MOST_BYTES, F.col("content"))
    places = placed(found.select("path"), "path")
    some = places.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    return found.join(F.broadcast(places) if some else places, "path").select(F.col("place").alias("ord"), "path", content.alias("content"), "length")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (filename, markdown), one row a file."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("markdown"))


def documents(df: DataFrame, text: str = "text", key: str = "doc_id", suffix: str = ".md") -> DataFrame:
    """Rows (ord, filename, markdown) of a table of texts."""
    return df.select(F.col(key).cast("long").alias("ord"), F.concat(F.lit(f"{key}_"), F.col(key).cast("string"), F.lit(suffix)).alias("filename"), F.col(text).alias("markdown"))


def cells(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row as display strings, nulls as ''."""
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns])
