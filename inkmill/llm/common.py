"""Pieces that the training-data operators share: shared storage, text rules, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import spread

#: One word: a run of bytes other than ASCII white space. The same set as Python's bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one only where driver and executors are one process."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkmill-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark drops it with its last reference where spark.cleaner.referenceTracking.cleanCheckpoints is set, else the cluster
    clears the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows and left to a shuffle beyond; it is read twice, so it should be cut."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table or archive that is written once and read again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; dealt to the cores where its files hold fewer row groups than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def guarded(docs: DataFrame, names: tuple[str, ...], function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """function(docs) with the columns of docs, those of docs that are called as its own columns are put aside meanwhile."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    out = function(docs.withColumnsRenamed(own))
    return out.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none. Native, and without an array of words: their last characters are counted."""
    last = r"[^\x20\x09-\x0D](?![^\x20\x09-\x0D])"
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, last, "")), F.lit(0)).cast("long")


#: Copies that one row is expanded to at a time.
COPIES = 1 << 16


def copied(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row as often as its column `times` says, numbered from 0 in the column `name`.

    A row of more than COPIES copies is first split into ranges of so many, which are dealt out, so that no task makes all
    copies of a hot row.
    """
    one = df.filter(F.col(times) <= COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)).alias(name)).filter(F.col(times) > 0)
    ranges = df.filter(F.col(times) > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    spread_out = ranges.repartition(*[F.col(f"`{c}`") for c in df.columns], F.col("_from"))
    many = spread_out.select(*df.columns, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col(times)) - 1)).alias(name))
    return one.unionByName(many)


def number_in(df: DataFrame, group: str, order: list[str], rows: int, per: int = 50_000, name: str = "slot", times: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, no group in one task.

    Rows are dealt to hash buckets of about `per` rows; the buckets' counts (few rows) give each bucket's first number, and
    a window numbers only within (group, bucket). With `times` a row stands for so many equal rows: it gets the first of
    their numbers. The rows should be distinct, so that none of them can fill a bucket.
    """
    weight = F.col(times) if times else F.lit(1).cast("long")
    buckets = max(1, -(-rows // per))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(group, "_bucket").agg(F.sum(weight).alias("_n"))
    past = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_first"))
    before = F.coalesce(F.sum(weight).over(Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = dealt.withColumn("_before", before).join(first, [group, "_bucket"])
    return joined.withColumn(name, (F.col("_first") + F.col("_before")).cast("long")).drop("_bucket", "_before", "_first")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps: each is a partial aggregation plus an equi-join on the edges' key, so a hub
    is split as any skewed join, and the edges never leave the executors. Nodes without an edge don't appear. The edges are
    checkpointed after every round; the loop ends when a round changes nothing.
    """
    directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    state, before = cut(directed), None
    for _ in range(rounds):
        total = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if total == before or not total[0]:
            break
        before = total
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # so that the join can split a hub's edges
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("x"), "m").unionByName(near.select(F.col("u").alias("x"), "m"))
        state = cut(small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaf = state.select(F.col("u").alias("node"), F.col("v").alias("component"))  # of stars, so each node once
    roots = state.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))  # a hub comes once from each task
    return leaf.unionByName(roots)


def named_by_least(group: DataFrame, nodes: DataFrame, salts: int = 64) -> DataFrame:
    """(node, least) of components (node, component): the smallest id that nodes (node, id) give to a node of the component.

    The nodes of a component are dealt to `salts` parts before they meet its least id, so a component of any size is spread.
    Both joins are merges at any size: a broadcast of the nodes would leave all of a component to the task that has its least id.
    """
    named = group.join(nodes.select("node", "id"), "node").withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
    parts = named.groupBy("component", "_salt").agg(F.min("id").alias("_least"))
    least = parts.groupBy("component").agg(F.min("_least").alias("least"))
    shares = parts.select("component", "_salt").join(least.hint("merge"), "component")
    return named.join(shares.hint("merge"), ["component", "_salt"]).select("node", "least")


def lowest(hit: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ids the smallest id that it reaches by hit, links between the rows at left and those at right."""
    low, most = ids.copy(), np.iinfo(np.int64).max
    while hit.any():
        before = low.copy()
        low[left] = np.minimum(low[left], np.where(hit, low[right][None, :], most).min(axis=1))
        low[right] = np.minimum(low[right], np.where(hit, low[left][:, None], most).min(axis=0))
        if (before == low).all():
            break
    return low
