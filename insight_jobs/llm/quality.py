"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

A token is a run of letters and digits or a run of marks. Every token type has a sparse random index vector; its word
vector is its own index vector plus the normalised sum of its neighbours' index vectors over the training sample,
scaled to length 1. A document's vectors are pooled into their mean, the length of that mean, and the mean inner product of
vectors at distances 1 to 4 (how much a text says the same again). A network with one hidden layer learns the label; a
temperature fitted on rows kept aside calibrates its probabilities.

Tokens outside the vocabulary have the index vector of their hash bucket. Null and empty texts have the score of the
zero vector. Very long texts are pooled whole, piece by piece. Equal rows have equal scores, with or without doc_id; of
several labels of one doc_id the smallest counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, in_batches, keyed_texts, labelled_rows

TOKEN = re.compile(r"\w+|[^\w\s]+")
PIECE = 20_000
LAGS = (1, 2, 3, 4)
#: Score from which a document counts as good.
CUT = 0.3


class Vectors:
    """Vocabulary and vectors; `rows` has the vocabulary first, then `spare` rows for the hashes of other tokens."""

    def __init__(self, dim: int, spare: int):
        self.dim, self.spare = dim, spare
        self.vocabulary: dict[str, int] = {}
        self.rows = np.zeros((spare, dim), np.float32)

    def number(self, token: str) -> int:
        k = self.vocabulary.get(token)
        return k if k is not None else len(self.vocabulary) + zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.spare

    def learn(self, texts: list[str], most: int, least: int, reach: int = 2, seed: int = 7, filled: int = 8) -> Vectors:
        """Index and context vectors of the tokens that at least `least` texts have, `most` of them at most."""
        df = Counter(t for text in texts for t in set(TOKEN.findall(text)))
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: (-df[t], t))[:most]
        self.vocabulary = {t: k for k, t in enumerate(kept)}
        rng, n = np.random.default_rng(seed), self.spare + len(kept)
        index = np.zeros((n, self.dim), np.float32)
        for _ in range(filled):
            index[np.arange(n), rng.integers(0, self.dim, n)] += rng.choice([-1.0, 1.0], n) / np.sqrt(filled)
        index = np.roll(index, len(kept), axis=0)
        around = np.zeros_like(index)
        for text in texts:
            ids = np.fromiter(map(self.number, TOKEN.findall(text)), np.int64)
            for start in range(0, len(ids), PIECE):
                piece = ids[start : start + PIECE + reach]
                for d in range(1, min(reach, len(piece) - 1) + 1):
                    left = piece[:-d][:PIECE]
                    np.add.at(around, left, index[piece[d : d + len(left)]])
                    np.add.at(around, piece[d : d + len(left)], index[left])
        rows = index + around / np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
        self.rows = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self


class Network:
    """Input, tanh layer, sigmoid; `temperature` divides the output before the sigmoid."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 0.01, decay: float = 1e-3) -> Network:
        """Adam on four fifths of the rows, then the temperature on the rest; of fewer than five rows all serve both."""
        aside = np.arange(len(x)) % 5 == 4
        taught = ~aside | (not aside.any())
        aside |= not aside.any()
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        u, v = (x[taught] - self.mean) / self.scale, y[taught]
        m, s = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p]
        for step in range(1, rounds + 1):
            a, b, c, d = self.p
            h = np.tanh(u @ a + b)
            g = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - v) / len(v)
            back = np.outer(g, c) * (1 - h * h)
            for k, grad in enumerate((u.T @ back + decay * a, back.sum(0), h.T @ g + decay * c, np.array([g.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logits(x[aside]), y[aside]
        loss = {q: float(np.mean(np.logaddexp(0, z / q) - t * z / q)) for q in np.geomspace(0.25, 8, 41)}
        self.temperature = float(min(loss, key=loss.get))
        return self


class Model:
    def __init__(self, vectors: Vectors, network: Network | None):
        self.vectors, self.network = vectors, network


class Tokens(dict):
    """Rows of tokens, kept while there are fewer than `bound`."""

    def __init__(self, vectors: Vectors, bound: int = 500_000):
        super().__init__()
        self.vectors, self.bound = vectors, bound

    def __missing__(self, token: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[token] = self.vectors.number(token)
        return value


def pooled(text: str, tokens: Tokens) -> np.ndarray:
    """A document's input for the network; long texts are pooled in pieces, so that memory stays bounded."""
    rows, dim = tokens.vectors.rows, tokens.vectors.dim
    words = TOKEN.findall(text)
    n = len(words)
    ids = np.fromiter(map(tokens.__getitem__, words), np.int64, n)
    total, like = np.zeros(dim), np.zeros(len(LAGS))
    for start in range(0, n, PIECE):
        v = rows[ids[start : start + PIECE + LAGS[-1]]]
        total += v[:PIECE].sum(0)
        for k, lag in enumerate(LAGS):
            left = v[:-lag][:PIECE]
            like[k] += np.vdot(left, v[lag : lag + len(left)])
    mean = total / max(1, n)
    return np.concatenate([mean, [np.linalg.norm(mean)], like / np.maximum(1, n - np.array(LAGS))])


def fit(rows: list[tuple[str, int]], dim: int = 64, most: int = 20_000, least: int = 3, spare: int = 2048) -> Model:
    if not rows:
        return Model(Vectors(dim, spare), None)
    vectors = Vectors(dim, spare).learn([t for t, _ in rows], most, least)
    tokens = Tokens(vectors)
    x = np.array([pooled(t, tokens) for t, _ in rows])
    return Model(vectors, Network(x.shape[1]).fit(x, np.array([y for _, y in rows], np.float64)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; 0.5 where no labelled row could be learned from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        m = shared.value
        tokens = Tokens(m.vectors)

        def work(batch: pa.RecordBatch) -> dict:
            x = np.array([pooled(t or "", tokens) for t in batch.column("text").to_pylist()])
            return {"doc_id": batch.column("doc_id"), "score": m.network.probability(x) if m.network else np.full(len(x), 0.5)}

        return work

    slim, kind = keyed_texts(docs)
    return in_batches(slim, pa.schema([("doc_id", kind), ("score", pa.float64())]), begin)


def learned(docs: DataFrame, labels: DataFrame, bound: int = 3000) -> Model:
    """The model fitted on at most `bound` labelled rows outside the held-out fold."""
    return fitted(labelled_rows(docs, labels, "quality", 5, 0, bound), fit)


def quality(docs: DataFrame, labels: DataFrame, bound: int = 3000, cut: float = CUT) -> DataFrame:
    """Fit on at most `bound` labelled rows outside the held-out fold, then score every document."""
    model = learned(docs, labels, bound)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
