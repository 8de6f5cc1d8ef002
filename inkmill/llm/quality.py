"""Quality rules: statistics of whole texts, and an isolation forest over them with a threshold set by labelled rows."""

from __future__ import annotations

import re
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import cut, read

#: At least so many trees, and as many as it takes for every labelled row to be in one; rows of a tree.
TREES, TREE_ROWS = 200, 256
#: Of the rows a tree is grown on, at most this share has label quality 0, so that they stay anomalies.
ODD_SHARE = 0.02
#: The threshold keeps at least this share of the labelled rows of quality 1 that pass the base rules.
KEEP = 0.998
MIN_WORDS = 50
#: The rule statistics that the forest sees, in steps: what differs by less than a step is the same to a split. Words, repeated
#: words and repeated lines are judged by the base rules alone: with them as features the forest isolates good texts that are
#: short or repeat themselves, and drops a fifth of the bad ones instead of all (figures in the README).
RATES = {"mean_word": 1.0, "symbols": 0.05, "upper": 0.1, "digits": 0.1, "marks": 0.02, "pipes": 0.05}
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Path lengths are summed in steps of one over this, so that the order of the trees doesn't matter.
FINE = 1 << 32
#: Distinct rates that are broadcast with their scores; more have a shuffle.
BROADCAST = 100_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), dtype=np.int64, count=n)  # first positions name the words
    if n < 4:
        return 0
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts, and the rates that the forest sees, as whole steps. Words are runs of other than ASCII white space; null has none."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            if line in seen:
                dup += 1
            seen.add(line)
    repeats = repeated_words(words)
    per = max(1, chars)
    rates = {
        "mean_word": chars / max(1, n),
        "symbols": symbols / per,
        "upper": len(_UPPER.findall(text)) / per,
        "digits": len(_DIGIT.findall(text)) / per,
        "marks": (text.count("!") + text.count("?")) / per,
        "pipes": text.count("|") / per,
    }
    return [n, chars, symbols, dup, repeats], [float(rates[k] // step) for k, step in RATES.items()]


def base_failed(counts) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]


def shuffled(places: np.ndarray, total: int, seed: list[int]) -> np.ndarray:
    """What a shuffle of 0 to total - 1 has at these places: a Feistel network over enough bits, walked until it is inside."""
    half = np.uint64(max(1, (total.bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(1 << 62, size=6, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for key in keys:
            left, right = right, left ^ (((right + key) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & mask)
        return left << half | right

    out = once(places.astype(np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Forest:
    """Isolation trees as arrays; path lengths of many rows at once. Equal rows may be one row with a number of times."""

    def __init__(self, x: np.ndarray, odd: np.ndarray | None = None, times: np.ndarray | None = None, trees: int | range | None = None, size: int = TREE_ROWS, share: float = ODD_SHARE, seed: int = 7):
        """odd marks the rows of which a tree gets only the share (one at least). Each kind is dealt to the trees shuffle by shuffle,
        so every row is in equally many trees, but for one. trees is a number or a range of them, by default as many as it takes."""
        times = np.ones(len(x), dtype=np.int64) if times is None else np.asarray(times, dtype=np.int64)
        odd = np.zeros(len(x), dtype=bool) if odd is None or odd.all() else odd
        self.seed = seed
        self.kinds = [(np.flatnonzero(kind), np.cumsum(times[kind])) for kind in (~odd, odd)]
        plain, rare = (int(ends[-1]) if len(ends) else 0 for _, ends in self.kinds)
        some = min(rare, max(1, round(share * min(size, plain))))
        self.shares = min(size - some, plain), some
        self.needed = max(TREES, *(-(-n // max(1, part)) for n, part in zip((plain, rare), self.shares)))
        self.depth = max(1, int(np.ceil(np.log2(max(2, sum(self.shares))))))
        self.scale = self.expected(sum(self.shares))
        numbers = range(self.needed) if trees is None else range(trees) if isinstance(trees, int) else trees
        self.trees = [self.grow(x[self.dealt(t)], np.random.default_rng([seed, t])) for t in numbers]

    def dealt(self, tree: int) -> np.ndarray:
        """The rows of a tree: of each kind the next ones of an endless row of shuffles."""
        out = []
        for k, ((rows, ends), left) in enumerate(zip(self.kinds, self.shares)):
            at = tree * left
            while left:
                turn, place = divmod(at, int(ends[-1]))
                n = min(left, int(ends[-1]) - place)
                out.append(rows[np.searchsorted(ends, shuffled(np.arange(place, place + n), int(ends[-1]), [self.seed, k, turn]), side="right")])
                at, left = at + n, left - n
        return np.concatenate(out)

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (length, depth + self.expected(len(rows)))):
                column.append(value)
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < self.depth and len(rows) > 1 and len(open_):
                f = int(rng.choice(open_))
                c = float(rng.uniform(low[f], high[f]))
                goes = rows[:, f] < c
                feature[at], cut[at] = f, c
                left[at], right[at] = node(rows[goes], depth + 1), node(rows[~goes], depth + 1)
            return at

        node(x, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(length)

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Path lengths summed over the trees, in whole steps."""
        total = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += np.rint(length * FINE).astype(np.int64)[at]
        return total

    def anomaly(self, lengths: np.ndarray, trees: int) -> np.ndarray:
        """2 ^ -(mean path length / expected): near 1 for anomalies."""
        return 2.0 ** -(lengths / FINE / trees / max(self.scale, 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.anomaly(self.lengths(x), len(self.trees))


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = KEEP, times: np.ndarray | None = None) -> float:
    """The score above which rows are dropped: of those that keep enough good rows, the one that divides the classes best.

    All scores are tried; times says how many rows each stands for. Of equally good ones the lowest is taken.
    """
    if not len(scores) or not good.any():
        return 1.0
    times = np.ones(len(scores)) if times is None else times
    tries, number = np.unique(scores, return_inverse=True)
    kept, missed = (np.cumsum(np.bincount(number, times * kind, len(tries))) for kind in (good, ~good))
    floor = int(np.searchsorted(kept, np.ceil((kept[-1] - 1) * keep), side="right"))
    if good.all():
        return float(tries[floor])
    gain = (missed[-1] - missed) / missed[-1] + kept / kept[-1]
    return float(tries[floor + int(np.argmax(gain[floor:]))])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed and the rates in steps of every document, from its whole text; written once."""
    fields = [StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("rates", ArrayType(DoubleType()))]

    def run(text: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in text]
        counts = pd.DataFrame(np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, len(COUNTS)), columns=COUNTS)
        return counts.assign(base_failed=[base_failed(r[0]) for r in rows], rates=[r[1] for r in rows])

    return cut(docs.select("doc_id", F.pandas_udf(run, StructType(fields))("text").alias("_q")).select("doc_id", "_q.*"))


def fit(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The distinct rates of the measured rows, their anomaly scores, and the threshold; scores of 0 and 1.0 without usable labels.

    Learned from every labelled row that passes the base rules: Spark counts them by rates and class, the trees are dealt all
    of them and grown in tasks, and the threshold weighs them all. Labels with a null doc_id or null quality are left out; of
    repeated labels the highest counts; repeated rows of a document are learned from as often.
    """
    spark = rows.sparkSession
    classes = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality in (0, 1)")
    seen = rows.filter("not base_failed").select("doc_id", "rates").join(classes, "doc_id").groupBy("rates", "quality").agg(F.count("*").alias("times")).collect()
    vectors = np.array(sorted(r.rates for r in rows.select("rates").distinct().collect()), dtype=np.float64).reshape(-1, len(RATES))
    if not seen:
        return vectors, np.zeros(len(vectors)), 1.0
    seen = sorted(seen, key=lambda r: (r.rates, r.quality))
    x, good, times = np.array([r.rates for r in seen], dtype=np.float64), np.array([r.quality == 1 for r in seen]), np.array([r.times for r in seen], dtype=np.int64)
    plan = Forest(x, ~good, times, range(0))

    def run(batches):
        total = np.zeros(len(vectors), dtype=np.int64)
        for pdf in batches:
            for t in pdf["id"]:  # a tree at a time, so that a task holds one
                total += Forest(x, ~good, times, range(t, t + 1)).lengths(vectors)
        yield pd.DataFrame({"at": np.arange(len(vectors)), "total": total})

    trees = spark.range(0, plan.needed, 1, min(plan.needed, spark.sparkContext.defaultParallelism))
    summed = trees.mapInPandas(run, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).toPandas().sort_values("at")
    scores = plan.anomaly(summed["total"].to_numpy(), plan.needed)
    place = {tuple(v): i for i, v in enumerate(vectors.tolist())}
    return vectors, scores, calibrate(scores[[place[tuple(r.rates)] for r in seen]], good, times=times)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, base_failed, anomaly score and kept for every document, from its whole text.

    Windows of three words found twice cover the words counted as repeated. A document is kept when no base rule fails and
    the forest's score is at most the calibrated threshold; without usable labelled rows the base rules alone decide. Null
    and empty texts have no words and fail; a score equal to the threshold is kept. Texts of any length are judged whole, one
    at a time; repeated rows and equal texts are judged alike, no rows give no rows. Rows with a null doc_id are judged like
    others and never learned from. Texts are read once and not shuffled; their statistics are written in the shared folder and
    meet the labels by doc_id. The driver holds the distinct rates in steps. Other columns are ignored.
    """
    rows = measured(docs)
    vectors, scores, threshold = fit(rows, labels)
    known = docs.sparkSession.createDataFrame(list(zip(vectors.tolist(), scores.tolist())), "rates array<double>, anomaly double")
    judged = rows.join(F.broadcast(known) if len(vectors) <= BROADCAST else known, "rates")
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") <= threshold)).alias("kept"), "anomaly")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
