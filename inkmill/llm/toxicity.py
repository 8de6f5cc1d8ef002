"""Toxic spans by a linear-chain conditional random field; its marginals make document scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import read

#: Labelled documents that the model is fitted on: of each class at most so many, first by a hash of doc_id.
SAMPLE = 3_000
#: Features of tokens: the whole word, and beginnings of so many letters.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Features that are weighed before some are chosen: at most so many, those that mark toxic documents best; they are what a model may know.
CANDIDATES = 1_500
#: Training documents of like length are padded to one; so many cells at most, or one document.
CELLS = 1 << 18
THRESHOLD = 0.3
#: Tokens of spans have at least this marginal.
SPAN = 0.5
_TOKEN = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
PIECE = 1 << 21


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id mod 4 is 2: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut where no token is."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        end = found.end() if found else len(text)
        yield at, text[at:end]
        at = end
    if at < len(text) or not at:
        yield at, text[at:]


def features(token: str) -> list[str]:
    """=word and ^beginning."""
    return ["=" + token, *("^" + token[:k] for k in BEGINNINGS if len(token) > k)]


class Known(dict):
    """What a token means, by a function of its known features; None without any. Remembers tokens."""

    def __init__(self, index: dict[str, int], value):
        super().__init__()
        self.index, self.value = index, value

    def __missing__(self, token: str):
        if len(self) > 200_000:
            self.clear()
        found = [self.index[f] for f in features(token) if f in self.index]
        self[token] = out = self.value(found) if found else None
        return out


def active(text: str, known: Known) -> tuple[int, list[int], list]:
    """Number of tokens, and the positions and meanings of those that are known. Tokens are runs of letters, lower-cased."""
    n, positions, values = 0, [], []
    for _, piece in pieces(text):
        tokens = _TOKEN.findall(piece.lower())
        for i, value in enumerate(map(known.__getitem__, tokens), n):
            if value is not None:
                positions.append(i)
                values.append(value)
        n += len(tokens)
    return n, positions, values


@dataclass
class Chain:
    """Two tags, clean and toxic. move[a][b] scores tag b after a, bias a toxic tag of any token, weights one of a known feature.

    Tokens without known features share one matrix, so k of them in a row are its k-th power, in closed form by its two
    eigenvalues: inference visits known tokens alone and is exact for the whole chain.
    """

    weights: np.ndarray
    move: np.ndarray
    bias: float

    def __post_init__(self):
        a = np.exp(self.move)
        self.step = a
        s = a * np.array([1.0, np.exp(self.bias)])
        half, det = (s[0, 0] + s[1, 1]) / 2, s[0, 0] * s[1, 1] - s[0, 1] * s[1, 0]
        root = np.sqrt(max(half * half - det, 1e-18))
        self.top, low = half + root, half - root
        self.ratio = low / self.top
        self.p1 = (s - low * np.eye(2)) / (self.top - low)
        self.p2 = np.eye(2) - self.p1

    def gaps(self, k: np.ndarray) -> np.ndarray:
        """The matrices of k tokens that are not known, over top ** k."""
        return self.p1 + (self.ratio ** k)[..., None, None] * self.p2

    def marginals(self, n: int, positions, scores) -> np.ndarray:
        """Probability of the toxic tag at each known token; scores are the sums of their features' weights."""
        k = np.diff(np.concatenate([[-1], positions, [n]])) - 1
        gap = self.gaps(np.asarray(k, dtype=np.float64))
        emit = np.stack([np.ones(len(scores)), np.exp(self.bias + np.asarray(scores))], axis=1)
        front = np.zeros((len(scores), 2))
        v = np.array([1.0, 0.0])  # a chain begins as if after a clean token
        for t in range(len(scores)):
            v = ((v @ gap[t]) @ self.step) * emit[t]
            v = v / v.sum()
            front[t] = v
        out = np.zeros(len(scores))
        back = gap[-1] @ np.ones(2)
        for t in range(len(scores) - 1, -1, -1):
            both = front[t] * back
            out[t] = both[1] / both.sum()
            back = gap[t] @ (self.step @ (emit[t] * back))
            back = back / back.sum()
        return out


class Batch:
    """Training documents padded to one length: log-likelihood and expectations of all at once."""

    def __init__(self, docs: list[tuple[int, list[int], list[tuple[int, ...]], int]], features: int):
        kinds: dict[tuple[int, ...], int] = {}
        docs = [(n, p, [kinds.setdefault(v, len(kinds)) for v in values], y) for n, p, values, y in docs]
        self.of = np.zeros((max(1, len(kinds)), features))
        for kind, i in kinds.items():
            self.of[i, list(kind)] = 1.0
        self.width = max((len(d[1]) for d in docs), default=0)
        self.gap = np.zeros((len(docs), self.width + 1))
        self.word = np.zeros((len(docs), self.width), dtype=np.int64)
        self.real = np.zeros((len(docs), self.width), dtype=bool)
        self.n = np.array([d[0] for d in docs], dtype=np.float64)
        self.toxic = np.array([d[3] for d in docs], dtype=bool)
        moves = np.zeros((len(docs), 3))  # clean to toxic, toxic to clean, toxic to toxic
        for i, (n, positions, numbers, toxic) in enumerate(docs):
            m = len(positions)
            self.gap[i, : m + 1] = np.diff([-1, *positions, n]) - 1
            self.word[i, :m] = numbers
            self.real[i, :m] = True
            if toxic and m:
                joined = sum(b == a + 1 for a, b in zip(positions, positions[1:]))
                moves[i] = (m - joined, m - joined - (positions[-1] == n - 1), joined)
        self.tagged = self.real & self.toxic[:, None]
        self.moves = moves.sum(axis=0)

    def forward(self, chain: Chain) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood, and for `expected` the matrices of all steps, the last gaps and the forward vectors."""
        gap = chain.gaps(self.gap)
        scores = (self.of @ chain.weights)[self.word]
        steps = gap[:, : self.width] @ chain.step
        steps[..., 1] *= np.exp(chain.bias + scores)[..., None]
        steps[~self.real] = np.eye(2)
        v = np.tile([1.0, 0.0], (len(self.n), 1))
        totals = np.ones(self.word.shape)
        front = np.zeros((*self.word.shape, 2))
        for t in range(self.width):
            v = np.matmul(v[:, None, :], steps[:, t])[:, 0]
            totals[:, t] = total = v.sum(axis=1)
            v = v / total[:, None]
            front[:, t] = v
        last = np.take_along_axis(gap, self.real.sum(axis=1)[:, None, None, None], axis=1)[:, 0].sum(axis=2)
        log = (self.n - self.real.sum(axis=1)) * np.log(chain.top) + np.log(totals).sum(axis=1) + np.log((v * last).sum(axis=1))
        score = scores[self.tagged].sum() + chain.bias * self.tagged.sum() + self.moves @ np.array([chain.move[0, 1], chain.move[1, 0], chain.move[1, 1]])
        return float(score - log.sum()), steps, last, front

    def expected(self, steps: np.ndarray, last: np.ndarray, front: np.ndarray) -> np.ndarray:
        """Toxic marginals of the known tokens."""
        out = np.zeros(self.word.shape)
        back = last
        for t in range(self.width - 1, -1, -1):
            both = front[:, t] * back
            out[:, t] = both[:, 1] / both.sum(axis=1)
            back = np.matmul(steps[:, t], back[:, :, None])[..., 0]
            back = back / back.sum(axis=1, keepdims=True)
        return np.where(self.real, out, 0.0)


def batches(docs: list[tuple[int, list[int], list[tuple[int, ...]], int]], features: int) -> list[Batch]:
    """The documents in batches of like numbers of known tokens, all of which are learned from."""
    out: list[list] = []
    for d in sorted(docs, key=lambda d: len(d[1])):
        if not out or (len(out[-1]) + 1) * len(d[1]) > CELLS:
            out.append([])
        out[-1].append(d)
    return [Batch(b, features) for b in out]


def chain_of(x: np.ndarray, features: int) -> Chain:
    """The chain of a vector of parameters: weights, three moves, bias."""
    return Chain(x[:features], np.array([[0.0, x[-4]], [x[-3], x[-2]]]), x[-1])


def slope(parts: list[Batch], x: np.ndarray, features: int) -> np.ndarray:
    """The gradient of the log-likelihood of all batches."""
    now = chain_of(x, features)
    grad = np.zeros_like(x)
    for batch in parts:
        value, steps, last, front = batch.forward(now)
        by_kind = np.bincount(batch.word[batch.real], (batch.tagged - batch.expected(steps, last, front))[batch.real], len(batch.of))
        grad[:features] += by_kind @ batch.of
        for k in range(4):  # of the few that all gaps depend on, by a difference
            moved = x.copy()
            moved[features + k] += 1e-4
            grad[features + k] += (batch.forward(chain_of(moved, features))[0] - value) / 1e-4
    return grad


def train(docs: list[tuple[int, list[int], list[tuple[int, ...]], int]], features: int, rounds: int = 40, ridge: float = 0.05) -> Chain:
    """Maximum penalised conditional likelihood by Adam. Known tokens of toxic documents are tagged toxic, all else clean."""
    some = [d for d in docs if d[1]]
    some += [d for d in docs if not d[1]][: max(200, len(some) // 2)]
    parts = batches(some, features)
    x = np.concatenate([np.zeros(features), [-2.0, 1.0, -1.0, -4.0]])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for r in range(1, rounds + 1):
        grad = slope(parts, x, features) / len(some) - ridge / len(some) * x
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        x = x + 0.4 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
        x[-4:] = np.clip(x[-4:], -12, 4)
    return chain_of(x, features)


def shape(n: int, marginals: np.ndarray) -> tuple[float, float, float]:
    """What a document's marginals say: log-odds of any toxic token, of how many, and how densely."""
    none = float(np.log1p(-np.minimum(marginals, 1 - 1e-6)).sum())
    some = -np.expm1(none)
    odds = float(np.clip(np.log(max(some, 1e-12)) - none, -7, 7))
    total = float(marginals.sum())
    return odds, float(np.log1p(total)), float(min(1.0, total / max(1, n)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.5) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    damp = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w = w + np.clip(step, -4, 4)
    return w


@dataclass
class Model:
    index: dict[str, int]
    chain: Chain | None
    weights: np.ndarray

    def __post_init__(self):
        self.known = Known(self.index, lambda found: float(self.chain.weights[found].sum()))

    def __getstate__(self):
        return self.index, self.chain, self.weights

    def __setstate__(self, state):
        self.index, self.chain, self.weights = state
        self.__post_init__()

    def marginals(self, text: str) -> tuple[int, list[int], np.ndarray]:
        n, positions, scores = active(text, self.known)
        return n, positions, self.chain.marginals(n, positions, scores) if positions else np.zeros(0)

    def score(self, text: str | None) -> float:
        n, _, marginals = self.marginals(text or "")
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ np.array(shape(n, marginals)), -30, 30))))

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of the tokens that are toxic, in characters; neighbours join."""
        n, positions, marginals = self.marginals(text or "")
        at = {p: float(m) for p, m in zip(positions, marginals) if m >= SPAN}
        out: list[tuple[int, int, float]] = []
        if at:
            last = -2
            tokens = (m for offset, piece in pieces(text) for m in ((offset + t.start(), offset + t.end()) for t in _TOKEN.finditer(piece)))
            for i, (start, end) in enumerate(tokens):
                if i in at:
                    if i == last + 1:
                        out[-1] = (out[-1][0], end, max(out[-1][2], at[i]))
                    else:
                        out.append((start, end, at[i]))
                    last = i
        return out


def choose(docs: list[set[str]], toxic: list[bool]) -> list[str]:
    """The features to know, of those given for each document: those needed to explain the toxic ones.

    A feature explains a document that has it; each toxic document is to be explained twice. The feature that explains most
    goes first, and those that add few don't go: so what only rides along in copies of a toxic text stays unknown.
    """
    left = {i: 2 for i, y in enumerate(toxic) if y}
    least = max(4, round(0.005 * len(left)))
    where: dict[str, set[int]] = {}
    for i in left:
        for f in docs[i]:
            where.setdefault(f, set()).add(i)
    out: list[str] = []
    while where:
        best = min(where, key=lambda f: (-sum(left[i] > 0 for i in where[f]), f[0] != "=", -len(f), f))
        holds = where.pop(best)
        if sum(left[i] > 0 for i in holds) < least:
            break
        out.append(best)
        for i in holds:
            left[i] -= 1
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out; without both classes it scores alike.

    Of each class at most `sample` documents are learned from, the first by a hash of doc_id, in all their tokens; the model
    knows at most `candidates` features, those whose rates in the two classes differ most. Labels with a null doc_id or null
    toxic are left out; of repeated labels the highest counts; repeated rows of a document are learned from as often.
    """
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id"))
    drawn = [rows.filter(F.col("toxic") == y).orderBy("_h").limit(sample).select("doc_id", "toxic") for y in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * sample rows of 12 bytes
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def counts(batches):
        for pdf in batches:
            both: tuple[Counter, Counter] = Counter(), Counter()
            for y, t in zip(pdf["toxic"], pdf["text"]):
                words = {w for _, p in pieces(t or "") for w in _TOKEN.findall(p.lower())}
                both[y].update({f for w in words for f in features(w)})
            names = list(both[0].keys() | both[1].keys())
            yield pd.DataFrame({"feature": names, "c": [both[0][f] for f in names], "t": [both[1][f] for f in names]})

    summed = texts.mapInPandas(counts, "feature string, c long, t long").groupBy("feature").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    margin = F.col("t") * max(1, clean) - 2 * F.col("c") * max(1, bad)  # by rates of the classes
    likely = summed.filter((F.col("t") >= 3) & (margin > 0)).orderBy(margin.desc(), "feature").limit(4 * candidates).toPandas()
    least = max(3, round(0.005 * bad))
    precise = [f for f, c, t in zip(likely["feature"], likely["c"], likely["t"]) if t >= least and (t + 0.5) / (bad + 1) >= 9 * (c + 0.5) / (clean + 1)][:candidates]
    index = {f: i for i, f in enumerate(precise)}

    def places(batches):
        known = Known(index, list)
        for pdf in batches:
            found = [active(t or "", known) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "n": [f[0] for f in found], "at": [f[1] for f in found], "has": [f[2] for f in found]})

    seen = texts.mapInPandas(places, "doc_id long, toxic int, n long, at array<long>, has array<array<int>>").toPandas().sort_values("doc_id", kind="stable")
    toxic = [bool(y) for y in seen["toxic"]]
    if not any(toxic) or all(toxic):
        prior = np.clip((sum(toxic) + 0.5) / (len(toxic) + 1), 0.01, 0.99) if toxic else 0.01
        return Model({}, None, np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0]))
    chosen_features = choose([{precise[f] for token in row for f in token} for row in seen["has"]], toxic)
    number = {index[f]: i for i, f in enumerate(chosen_features)}
    chains = []
    for n, at, has, y in zip(seen["n"], seen["at"], seen["has"], toxic):
        kept = [(int(a), v) for a, token in zip(at, has) if (v := tuple(number[int(f)] for f in token if int(f) in number))]
        chains.append((int(n), [k[0] for k in kept], [k[1] for k in kept], int(y)))
    chain = train(chains, len(chosen_features)) if chosen_features else None
    x = np.array([shape(n, chain.marginals(n, p, [chain.weights[list(v)].sum() for v in w]) if p else np.zeros(0)) for n, p, w, _ in chains])
    return Model({f: i for i, f in enumerate(chosen_features)}, chain, logistic(x, np.array(toxic, dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and spans (start, end, marginal; in characters) added, each whole text in one pass.

    Null and empty texts have no tokens and get the score of a text without known tokens, no spans. Long texts are read in
    pieces, as one chain. Repeated rows and equal texts score alike, ids don't matter; no rows give no rows. Other columns
    pass by Python untouched; own columns called score or spans are replaced. No shuffle; the model's size is bounded.
    """
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("marginal", DoubleType())])
    result = StructType([StructField("score", DoubleType()), StructField("spans", ArrayType(span))])
    arrow = to_arrow_type(result)

    def run(text: pa.Array) -> pa.Array:
        rows = ({"score": model.score(t), "spans": [{"start": a, "end": b, "marginal": m} for a, b, m in model.spans(t)]} for t in text.to_pylist())
        return pa.array(list(rows), type=arrow)

    judged = docs.drop("score", "spans").withColumn("_t", F.arrow_udf(run, result)("text"))
    return judged.select("*", "_t.score", "_t.spans").drop("_t")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
