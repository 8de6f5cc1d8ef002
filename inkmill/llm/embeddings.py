"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in each cell, one row kept per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, few, lowest, named_by_least, read

THRESHOLD = 0.98
#: Vectors that the cells are fitted on, the first in order of a hash: of the table for the cells, of each cell for those below.
SAMPLE = 20_000
#: Vectors a cell should hold. Up to MOST_CELLS cells are one level; beyond, each is divided again, by as many at most.
PER_CELL, MOST_CELLS = 4_096, 1_024
#: All centres together hold at most so many bytes, which every Python worker keeps.
CENTRE_BYTES = 128 << 20
#: Rows of a block; a task compares two blocks.
BLOCK = 2_048
#: A vector also visits the cells whose border is within so many standard deviations of a linked pair's spread across it.
SIGMAS = 5.0
#: Up to so many cells' counts are broadcast (under 100 bytes each); beyond it they join by a shuffle.
BROADCAST_CELLS = 20_000
#: A cell's number is that of the first level times STRIDE plus that of the second.
STRIDE = 1 << 20
#: Rows whose products with all centres are held at a time.
ROWS = 1_024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit rows x: the mean direction of the rows nearest by cosine, from evenly spaced first rows."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        best = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        norms = np.linalg.norm(sums, axis=1)
        alive = norms > 0
        centres[alive] = sums[alive] / norms[alive, None]
    return centres


def visits(x: np.ndarray, centres: np.ndarray, margin: float) -> list[list[int]]:
    """For each unit row its nearest cell and those whose border it is within `margin` of, in ascending order."""
    dots = x @ centres.T
    home = dots.argmax(1)
    gap = dots[np.arange(len(x)), home][:, None] - dots
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-30))[home]
    near = gap <= margin * apart
    near[np.arange(len(x)), home] = True
    return [np.flatnonzero(row).tolist() for row in near]


class Cells:
    """Cells of one level, or of two where `below` has the centres that divide a cell of the first."""

    def __init__(self, top: np.ndarray, below: dict[int, np.ndarray], margin: float):
        self.top, self.below, self.margin = top, below, margin

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + ROWS] @ self.top.T).argmax(1) for i in range(0, len(x), ROWS)])

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """For each unit row the numbers of its cells, ascending.

        A pair on both sides of a border visits both cells, on either level, so it meets below each cell that it shares above.
        """
        out: list[list[int]] = [[] for _ in range(len(x))]
        for start in range(0, len(x), ROWS):
            part = x[start : start + ROWS]
            at: dict[int, list[int]] = {}
            for i, cells in enumerate(visits(part, self.top, self.margin)):
                for c in cells:
                    at.setdefault(c, []).append(i)
            for c in sorted(at):
                rows = at[c]
                lower = visits(part[rows], self.below[c], self.margin) if c in self.below else [[0]] * len(rows)
                for i, subs in zip(rows, lower):
                    out[start + i] += [c * STRIDE + s for s in subs]
        return out


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return (a @ b.T) / norms >= threshold


def _earlier(cells: list, cell: int) -> np.ndarray:
    """Bits of the cells before this one that each row visits."""
    before = [c[c < cell] for c in map(np.asarray, cells)]
    names = np.unique(np.concatenate(before))
    bits = np.zeros((len(cells), max(1, len(names))), dtype=bool)
    for i, c in enumerate(before):
        bits[i, np.searchsorted(names, c)] = True
    return np.packbits(bits, axis=1)


def _matrix(vectors: list, length: int) -> np.ndarray:
    """Unit rows of the vectors of that length."""
    x = np.array([v for v in vectors if len(v) == length], dtype=np.float64).reshape(-1, max(1, length))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def fit_cells(unique: DataFrame, n: int, margin: float, length: int, drawn: list, sample: int, per_cell: int, most_cells: int) -> Cells | None:
    """The cells for n distinct vectors: their number follows n, in two levels beyond most_cells.

    The first level is fitted on the drawn vectors. Those below are fitted cell by cell in tasks, each on at most `sample`
    vectors of its cell, as many as its count of vectors asks for; the centres, bounded by CENTRE_BYTES, come to the driver.
    """
    x = _matrix(drawn, length)
    if not len(x):
        return None
    most = CENTRE_BYTES // (8 * length)
    per_cell = max(per_cell, -(-n // most))
    first = Cells(spherical_kmeans(x, min(most_cells, most, max(4, n // per_cell))), {}, margin)
    if n <= per_cell * most_cells:
        return first

    def homes(batches):
        for pdf in batches:
            pdf = pdf[pdf["vector"].map(len) == length]
            if len(pdf):
                yield pd.DataFrame({"home": first.home(_matrix(pdf["vector"].tolist(), length)), "h": pdf["h"], "vector": pdf["vector"]})

    placed = unique.select(F.xxhash64("k1", "k2").alias("h"), "vector").mapInPandas(homes, "home int, h long, vector array<double>")
    sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # a row a cell of the first level

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf["home"].iloc[0])
        rows = _matrix(pdf.sort_values("h", kind="stable")["vector"].tolist(), length)
        centres = spherical_kmeans(rows, min(most_cells, max(1, -(-sizes[home] // per_cell))))
        return pd.DataFrame({"home": home, "sub": range(len(centres)), "centre": list(centres)})

    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("home").orderBy("h"))).filter(F.col("_r") <= sample).drop("_r")
    found = ranked.groupBy("home").applyInPandas(divide, "home int, sub int, centre array<double>").toPandas().sort_values(["home", "sub"])
    below = {int(home): np.array(part["centre"].tolist()) for home, part in found.groupby("home")}
    return Cells(first.top, below, margin)


def compare(threshold: float):
    """Two blocks of a cell in one task: links counted for each row, and its smallest partner through links seen here.

    A pair that meets in several cells counts in the first of them. No pairs leave the task.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[2], key[3], key[4]
        pdf = pdf.sort_values("node", kind="stable")
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        nodes, copies, block = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        hit = linked(x[left], x[right], threshold)
        if i == j:
            np.fill_diagonal(hit, False)
        counts = np.zeros(len(nodes), dtype=np.int64)
        p, q = np.nonzero(hit)
        seen = _earlier(pdf["cells"].tolist(), cell) if len(p) else None
        for at in range(0, len(p), 65_536):
            u, v = left[p[at : at + 65_536]], right[q[at : at + 65_536]]
            new = ~(seen[u] & seen[v]).any(axis=1)
            np.add.at(counts, u[new], copies[v[new]])
            if i != j:
                np.add.at(counts, v[new], copies[u[new]])
        touched = np.unique(np.concatenate([left[p], right[q]])) if len(p) else np.zeros(0, dtype=np.int64)
        low = lowest(hit, left, right, nodes)
        return pd.DataFrame({"node": nodes[touched], "links": counts[touched], "low": low[touched]})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, per_cell: int = PER_CELL, most_cells: int = MOST_CELLS, block: int = BLOCK, sigmas: float = SIGMAS
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label), one a row of vectors.

    Vectors link when their labels are equal and their cosine, in double precision, is at least `threshold`, a tie included;
    labels and vec_ids that are null, and vectors that are null, zero or hold null or non-finite components, link with
    nothing, nor do vectors of different lengths. Rows with equal label and vector are collapsed first, into one node, and
    count as so many links each; a repeated row is a copy like any other. Rows of one vec_id with different labels or vectors
    are different nodes: each has its own links, they aren't linked by their id, and a component's id is the smallest vec_id
    of its nodes, so such rows may be in two components. Cells are fitted on a bounded sample, their number follows that of
    the vectors (fit_cells); a vector visits its nearest cell and those just across a border, so that a linked pair meets in
    one. (`sigmas` states how far: at 5 the spread of a pair at the threshold in a random direction; the border distance that
    can never lose one is sqrt(2 - 2 threshold), at sigmas = sqrt(dimension).) A cell of any size is split into blocks that
    are compared pair by pair in different tasks, which give counts and one edge a row, never pairs. Tables with no rows give
    none; other columns are ignored.
    """
    array = F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", "label", array.alias("vector"))
    fit_for = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda v: v != 0)
    keyed = rows.withColumn("fit", F.coalesce(fit_for, F.lit(False)))
    keyed = keyed.withColumn("k1", F.when(F.col("fit"), F.xxhash64("label", "vector"))).withColumn("k2", F.when(F.col("fit"), F.xxhash64(F.lit(1), F.reverse("vector"), "label")))
    usable = keyed.filter("fit")
    unique = usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    unique = cut(unique.withColumn("node", F.monotonically_increasing_id()))
    n = unique.count()
    drawn = unique.select("vector", F.xxhash64("k1", "k2").alias("_h"), "k1").orderBy("_h", "k1").limit(sample).select("vector").toPandas()["vector"].tolist()
    lengths = pd.Series([len(v) for v in drawn])
    length = int(lengths.mode()[0]) if len(lengths) else 0
    margin = sigmas * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(max(1, length)) + 1e-9
    cells = fit_cells(unique, n, margin, length, drawn, sample, per_cell, most_cells)

    def assign(batches):
        for pdf in batches:
            fits = (pdf["vector"].map(len) == length).to_numpy()
            out = [[0]] * len(pdf)
            if fits.any():
                for i, found in zip(np.flatnonzero(fits), cells.visited(_matrix(pdf["vector"].tolist(), length))):
                    out[i] = found
            yield pdf.assign(cells=out)

    placed = cut(unique.select("node", "copies", "label", "vector").mapInPandas(assign, f"node long, copies long, label {dict(unique.dtypes)['label']}, vector array<double>, cells array<long>"))
    members = placed.withColumn("cell", F.explode("cells")).withColumn("size", F.size("vector"))
    counts = few(cut(members.groupBy("label", "size", "cell").agg(F.count("*").alias("_n")).filter("_n > 1")), BROADCAST_CELLS)
    blocks = members.join(counts, ["label", "size", "cell"]).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    pairs = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    found = pairs.select("label", "size", "cell", "i", "j", "node", "copies", "vector", "cells", "block").groupBy("label", "size", "cell", "i", "j")
    found = cut(found.applyInPandas(compare(threshold), "node long, links long, low long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = named_by_least(components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))), unique)
    info = unique.select("k1", "k2", "node", "id", "copies").join(links, "node", "left").join(group, "node", "left")
    info = info.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(info, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN lowest l USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
