"""Continuous ingestion: new documents become chunks with the same ids as in a batch, so sinks can upsert by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.kb import chunks_of, convert, process


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New files under a path as (ord, path, content). A stream has no last file, so ord is a hash of the path and says no order; chunk ids don't depend on it."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("ord"), "path", "content")


def stream_chunks(files: DataFrame, options: Options = Options()) -> DataFrame:
    """The chunks of files as they come; stateless, so no watermark is needed."""
    done = convert(files, options).filter("error is null")
    return chunks_of(process(done.select("ord", "filename", "markdown"), options))


def start(chunks: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch of chunks as a folder named by the batch: a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
