"""Sharding by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copied, cut, number_in, read

SHARDS = 24
#: Groups that one task differences at a time; also the share of all bytes, one in so many, from which a group is large.
PER_BUCKET = 20_000


def difference(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions, those with the largest spread first, oppositely ordered.

    parts: for each partial partition its ways' sums. Returns the sums of the combined ways, in descending order, and for
    each part the way of the result that each of its own ways went to. Ties go by position, so reruns agree.
    """
    ways = len(parts[0])
    heap, nodes = [], []
    for i, part in enumerate(parts):
        order = sorted(range(ways), key=lambda j: (-part[j], j))
        sums = [part[j] for j in order]
        nodes.append(order)
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []  # left node, right node, for each way of the result its way in the left node
    base = len(parts)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(ways), key=lambda j: (-both[j], j))
        sums = [both[j] for j in order]
        merged.append((a, b, order))
        heapq.heappush(heap, (sums[-1] - sums[0], base + len(merged) - 1, sums))
    total = heap[0][2]
    to: dict[int, list[int]] = {heap[0][1]: list(range(ways))}
    for k in range(len(merged) - 1, -1, -1):  # from the last combination down: where each way ends
        a, b, order = merged[k]
        ends = to.pop(base + k)
        left, right = [0] * ways, [0] * ways
        for j, way in enumerate(order):
            left[way] = ends[j]
            right[ways - 1 - way] = ends[j]
        to[a], to[b] = left, right
    out = []
    for i, order in enumerate(nodes):
        ends = [0] * ways
        for j, way in enumerate(order):
            ends[way] = to[i][j]
        out.append(ends)
    return total, out


def _large(ways: int):
    """The large groups in one task; sums is what each way holds, on the first row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2"], kind="stable")
        sums, ends = difference([[int(b)] + [0] * (ways - 1) for b in pdf["bytes"]])
        return pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "shard": [e[0] for e in ends], "sums": [sums if i == 0 else None for i in range(len(pdf))]})

    return run


def _bucket(held: list[int], total: int):
    """A bucket of other groups. Its share of what the large ones hold is one more partial partition, whose ways name the shards.

    Shards that hold as much of the large groups are alike: even and odd buckets order their ways oppositely among them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2"], kind="stable")
        sizes = [int(b) for b in pdf["bytes"]]
        mine, ways = sum(sizes), len(held)
        sums, ends = difference([[h * mine // max(1, total) for h in held], *([b] + [0] * (ways - 1) for b in sizes)])
        shard_of = {}
        for value in set(held):
            alike = [j for j in range(ways) if held[j] == value]
            met = sorted((ends[0][j] for j in alike), key=lambda w: (sums[w], w), reverse=int(pdf["bucket"].iloc[0]) % 2 == 0)
            shard_of |= dict(zip(met, alike))
        return pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "shard": [shard_of[e[0]] for e in ends[1:]]})

    return run


def shard(docs: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): documents with equal texts stay together, the shards' bytes near equal.

    size is the UTF-8 bytes plus 8. Equal texts are one indivisible group, found by 128 bits of hash; a group's size is summed
    in part before the shuffle, so a group of a third of all rows is one row here. Groups over one in per_bucket of all bytes,
    of which there are fewer than per_bucket, are differenced in one task. The others are dealt to hash buckets of about
    per_bucket groups; each bucket's task differences them together with its share of what the large groups hold, so it
    makes up for them. No task and not the driver ever holds all groups. A group larger than a shard's share keeps one shard
    for itself; the others stay even. A null text counts as an empty one (no bytes); both have crc 0. Repeated rows are
    counted first and numbered as one row with so many slots, so they fill no task; null doc_ids are numbered as others.
    Texts of any length are read once, for size and hashes. No rows give no rows. Extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("k2"),
    )
    row = measured.columns
    narrow = cut(measured.groupBy(*row).agg(F.count("*").alias("times")))
    rows = narrow.count()
    groups = cut(narrow.groupBy("k1", "k2").agg(F.sum(F.col("size") * F.col("times")).alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    is_large = F.col("bytes") * per_bucket > total
    large = cut(groups.filter(is_large).withColumn("task", F.lit(0)).groupBy("task").applyInPandas(_large(shards), "k1 long, k2 long, shard int, sums array<long>"))
    found = large.filter("sums is not null").select("sums").first()
    held = [int(x) for x in found["sums"]] if found else [0] * shards
    buckets = max(1, -(-rows // per_bucket))
    dealt = groups.filter(~is_large).withColumn("bucket", F.pmod("k2", F.lit(buckets)))
    others = dealt.groupBy("bucket").applyInPandas(_bucket(held, total - sum(held)), "k1 long, k2 long, shard int")
    final = cut(others.unionByName(large.select("k1", "k2", "shard")))
    numbered = number_in(narrow.join(final, ["k1", "k2"]), "shard", row, rows, name="first", times="times")
    slot = (F.col("first") + F.col("copy")).alias("slot")
    return copied(numbered, "times", "copy").select("doc_id", "size", "text_crc32", "shard", slot)


def op3_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
