"""Best-fit packing of documents into sequences, with conflicts between sources and between duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copied, cut, few, read, word_count

#: Words that a bin holds.
CAPACITY = 4_096
#: A bin takes one document of a slot. A source has so many slots at least, and so many times the documents of it that a bin
#: would hold if all bins were alike, so that bins can be filled whatever the number of sources.
SOURCE_SLOTS, ROOM = 8, 4
#: Up to so many sources' slots (under 100 bytes each) are broadcast; beyond it they join by a shuffle.
BROADCAST_SOURCES = 10_000
#: Pieces that one task packs; the number of tasks follows the input.
PER_TASK = 20_000


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, bitmap of conflicts), taken in the given order.

    Open bins are in a list by (residual, bin). The first with residual >= size is the tightest; from there the successors
    are tried until one shares no bit with the item. The item opens a bin if none is left.
    """
    order: list[tuple[int, int]] = []
    bitmaps: list[int] = []
    out = []
    for size, bits in items:
        at = bisect_left(order, (size, -1))
        while at < len(order) and bitmaps[order[at][1]] & bits:
            at += 1
        if at < len(order):
            left, number = order.pop(at)
            bitmaps[number] |= bits
        else:
            left, number = capacity, len(bitmaps)
            bitmaps.append(bits)
        out.append((number, capacity - left))
        if left > size:
            insort(order, (left - size, number))
    return out


def _task(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
        name: dict = {}
        clusters = pdf["cluster"].value_counts()
        several = set(clusters.index[clusters > 1])
        items = []
        for size, source, cluster in zip(pdf["size"], pdf["source_slot"], pdf["cluster"]):
            bits = 1 << name.setdefault(("s", source), len(name))
            if cluster in several:
                bits |= 1 << name.setdefault(("c", cluster), len(name))
            items.append((int(size), bits))
        placed = best_fit(items, capacity)
        task = int(pdf["task"].iloc[0])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "size": pdf["size"], "bin": [(task << 32) + b for b, _ in placed], "start": [s for _, s in placed]})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, source_slots: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """Rows (doc_id, piece, size, bin, start): every word of every document in one bin of at most `capacity` words.

    A document over the capacity, of any length, is cut into pieces of it, numbered from 0, and a rest; full pieces have a bin
    alone. No bin holds two rows of one duplicate cluster (equal texts, or the column `cluster` if docs has it; so no two
    pieces of a document) nor two of one source slot; a source has `source_slots` slots, or where that is None as many as follow from its
    share of all pieces. Null and empty texts
    have no words: one piece of size 0, which any bin with a word left takes that it has no conflict with. A null source is a
    source, null doc_ids pack as others. Repeated rows are counted first and dealt copy by copy. Pieces, not documents, are
    counted for the number of tasks and dealt evenly by hash, never by key, so hot sources, clusters and repeated rows are
    spread; bins are within a task, largest pieces first, ties by doc_id. The texts themselves aren't shuffled. Reruns agree.
    No rows give no rows; other columns are ignored.
    """
    cluster = F.xxhash64("cluster") if "cluster" in docs.columns else F.xxhash64("text", F.octet_length("text"))
    sized = docs.select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"), cluster.alias("cluster"), word_count(F.col("text")).alias("words"))
    rows = cut(sized.groupBy(*sized.columns).agg(F.count("*").alias("times")))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / capacity))
    by = cut(rows.groupBy("source").agg(F.sum(F.col("times") * (last + 1)).alias("pieces"), F.sum(F.col("times") * F.col("words")).alias("held")))
    total = by.agg(F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("held"), F.lit(0)).alias("words")).first()
    tasks = max(1, -(-total["pieces"] // per_task))
    alike = capacity / max(1, total["words"])  # of a source's pieces, so many would be in a bin
    follow = F.greatest(F.lit(SOURCE_SLOTS), F.least(F.lit(capacity), F.ceil(F.col("pieces") * (ROOM * alike)))) if source_slots is None else F.lit(source_slots)
    slots = by.select("source", follow.cast("int").alias("slots"))
    pieces = copied(rows.join(few(slots, BROADCAST_SOURCES), "source"), "times", "copy").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity)
    slot = F.xxhash64("source", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.col("slots")))
    task = F.pmod(F.xxhash64(F.lit(2), "doc_id", "cluster", "copy", "piece"), F.lit(tasks)).cast("int")
    dealt = pieces.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", size.alias("size"), "cluster", slot.alias("source_slot"), task.alias("task"))
    kind = dict(docs.dtypes)["doc_id"]
    packed = dealt.groupBy("task").applyInPandas(_task(capacity), "doc_id string, piece long, size long, bin long, start long")  # as text, ids beside nulls stay exact
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
