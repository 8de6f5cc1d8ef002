"""Near-duplicate texts: MinHash banding over word n-grams, pairs verified on the full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import components, cut, lowest, named_by_least, read

WORDS, SIMILARITY = 5, 0.8
#: A pair at the similarity sought shares a band with at least this probability.
RECALL = 0.9995
#: Rows of a band: the more, the fewer pairs of low similarity meet; the bands follow from the recall.
ROWS = 5
#: Texts of a block, and n-grams that it should hold; a task compares two blocks.
BLOCK, BLOCK_GRAMS = 256, 1_000_000
#: Up to so many candidates' ids (16 bytes each, with the hash of the text) are broadcast to find their texts; beyond it the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: A text is read in pieces of about so many characters, cut at white space.
PIECE = 1 << 22
SPACE = " \t\n\x0b\x0c\r"


def band_count(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed for the recall: 1 - (1 - similarity^rows)^bands >= recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


class _Hashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces that no word crosses; whole if it is short."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(c, at, at + most) for c in SPACE) + 1
        if end <= at:  # a word longer than a piece
            ends = [i for c in SPACE if (i := text.find(c, at + most)) >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the text's n-grams of lower-cased words, in order; a text of fewer words is one n-gram."""
    parts = []
    for piece in pieces(text or ""):
        words = piece.lower().encode("utf-8", "surrogatepass").split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words)))
    words = np.concatenate(parts)
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(out + np.uint64(n)))


class Sketch:
    """MinHash signatures cut into bands."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2)
        self.fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A hash for each band, which differs between bands."""
        low = None
        for at in range(0, len(x), 1024):
            h = np.multiply.outer(x[at : at + 1024], self.a)
            h += self.b
            part = h.min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return _mixed((low.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64) + self.place).view(np.int64)


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left sets with right sets, where wanted."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    p, q = np.nonzero(wanted)
    if len(p) <= 64:
        for i, j in zip(p, q):
            out[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
        return out
    sizes = np.array([len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = times[gram] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[gram[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        out += (dense[left] @ dense[right].T).astype(np.int64)
    return out


def _verify(rows: pd.DataFrame, n: int, similarity: float, i: int, j: int, bucket: int) -> pd.DataFrame | None:
    """Links between two blocks of a bucket that no earlier bucket of both texts has shown."""
    rows = rows.sort_values("node", kind="stable")
    nodes, copies, block = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if not len(left) or not len(right) or len(nodes) < 2:
        return None
    sets = [grams(t, n) for t in rows["text"]]
    own = np.array(rows["bands"].tolist(), dtype=np.int64)
    at = int(np.flatnonzero(own[0] == bucket)[0])
    wanted = np.ones((len(left), len(right)), dtype=bool) if i != j else ~np.eye(len(left), dtype=bool)
    for k in range(at):
        a, b = own[left, k], own[right, k]
        wanted &= ~((a[:, None] == b[None, :]) & (a != 0)[:, None])
    if i == j:
        wanted = np.triu(wanted)
    size = np.array([len(s) for s in sets])
    most, least = np.maximum(size[left][:, None], size[right][None, :]), np.minimum(size[left][:, None], size[right][None, :])
    wanted &= least >= similarity * most - 1e-9
    if not wanted.any():
        return None
    common = shared(sets, left, right, wanted)
    hit = wanted & (common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-9)
    if not hit.any():
        return None
    links = np.zeros(len(nodes), dtype=np.int64)
    links[left] += hit @ copies[right]
    links[right] += hit.T @ copies[left]
    touched = np.unique(np.concatenate([left[hit.any(axis=1)], right[hit.any(axis=0)]]))
    low = lowest(hit | hit.T if i == j else hit, left, right, nodes)
    return pd.DataFrame({"node": nodes[touched], "links": links[touched], "low": low[touched]})


def _groups(n: int, similarity: float):
    """Over rows sorted by (bucket, i, j): one verification for each run of equal keys."""

    def run(batches):
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[["bucket", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)]):
                new = tuple(int(v) for v in keys[lo])
                if new != key:
                    if held and (out := _verify(pd.concat(held), n, similarity, key[1], key[2], key[0])) is not None:
                        yield out
                    held, key = [], new
                held.append(pdf.iloc[lo:hi])
        if held and (out := _verify(pd.concat(held), n, similarity, key[1], key[2], key[0])) is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK, with_hash: bool = False) -> DataFrame:
    """Rows (doc_id, n_links, component_id, kept), a row for each of docs.

    Documents link when the Jaccard similarity of their sets of n-grams of lower-cased words reaches `similarity`, a tie
    included. Texts with equal sets are one node and link with each other. The nodes' bands are shuffled, not their texts;
    buckets with one member go, and of buckets with the same members one stays. One text of each node in what is left goes to
    tasks of two blocks, so a bucket of any size is split; a pair counts in the first bucket that it shares. Tasks give link
    counts and one edge a text, never pairs. component_id is the smallest doc_id reachable by links, kept is
    doc_id = component_id. Null and empty texts have no n-grams; they and null doc_ids link with nothing and are kept; a text
    of fewer words than n is one n-gram; long texts are read in pieces. Repeated rows are copies, of which one text is sent.
    Rows of one doc_id with different texts are different nodes: each has its own links, and they aren't linked by their id.
    `with_hash` adds text_hash, xxhash64 of the text, to tell them apart. No rows give no rows; other columns are ignored.
    """
    sketch = Sketch(band_count(similarity, recall, rows), rows)

    signature = StructType([StructField("k1", LongType()), StructField("k2", LongType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType()))])
    arrow = to_arrow_type(signature)

    def signed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            x = grams(text, n)
            if len(x):
                data = x.tobytes()
                keys = np.array([xxhash.xxh3_64_intdigest(data), xxhash.xxh64_intdigest(data, 7)], dtype=np.uint64).view(np.int64)
                out.append({"k1": int(keys[0]), "k2": int(keys[1]), "n": len(x), "bands": sketch(x)})
            else:
                out.append({"k1": None, "k2": None, "n": None, "bands": None})
        return pa.array(out, type=arrow)

    own = ["text_hash"] if with_hash else []
    keyed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.arrow_udf(signed, signature)("text").alias("_s")).select("doc_id", "text_hash", "_s.*"))
    equal = keyed.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2")
    unique = equal.agg(F.min(F.struct("doc_id", "text_hash")).alias("_of"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    unique = cut(unique.select("k1", "k2", F.col("_of.doc_id").alias("id"), "_of.text_hash", "copies", "n", "bands", F.monotonically_increasing_id().alias("node")))
    members = unique.select("node", "n", F.explode("bands").alias("bucket"))
    name = F.xxhash64("node")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(name).alias("f1"), F.sum(F.shiftright(name, 20)).alias("f2")).filter("m > 1")
    stay = buckets.groupBy("m", "f1", "f2").agg(F.min("bucket").alias("bucket"), F.first("total").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int")
    placed = members.join(stay.select("bucket", F.least(blocks, F.col("m").cast("int")).alias("blocks")), "bucket").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "blocks"))).alias("in"))
    seen = F.transform("bands", lambda b: F.when(F.map_contains_key("in", b), b).otherwise(F.lit(0).cast("long")))
    chosen = cut(placed.join(unique, "node").select("node", F.col("id").alias("doc_id"), "text_hash", "copies", "in", seen.alias("bands")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    ids = chosen.select("doc_id", "text_hash")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), ["doc_id", "text_hash"], "left_semi")
    once = texts.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))  # repeated rows go before the shuffle, by partial aggregation
    ready = once.join(chosen, ["doc_id", "text_hash"]).select("node", "copies", "bands", "text", F.explode("in").alias("bucket", "blocks"))
    ready = ready.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = ready.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "bands", "text")
    sorted_ = ready.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut(sorted_.mapInPandas(_groups(n, similarity), "node long, links long, low long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = named_by_least(components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))), unique)
    info = unique.select("k1", "k2", "node", "id", "copies").join(links, "node", "left").join(group, "node", "left")
    info = info.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = keyed.select("doc_id", "k1", "k2", *own).join(info, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", *own, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
