"""Toxicity by a linear-chain conditional random field over words.

Document labels become token labels: a word of a toxic training document is a toxic token if one of its features
(the word, its prefixes, its suffix) is found nearly only in toxic training documents. The chain learns these
tokens; forward-backward marginals give each word's probability, and from these a logistic calibration, fitted on
training documents that the chain has not seen, gives the document's score.

Nulls and empty texts have the score of a document without words. Equal rows have equal scores, with or without doc_id;
of several labels of one doc_id the smallest counts. Very long texts are scored whole, as one chain. Extra columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, in_batches, keyed_texts, labelled_rows
from .crf import Chain, blocks, padded

SEGMENT = 256
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
#: Score from which a document counts as toxic.
CUT = 0.3


def token_features(word: str) -> list[str]:
    """The word without marks at its ends, its prefixes and its suffix."""
    w = word.lower().strip(EDGES)
    return [f"={w}", w[:3], w[:4], w[:5], w[:6], w[:7], w[:8], f"-{w[-4:]}"]


class Words:
    """Numbers words and features; feature 0 is had by every word."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.named: dict[str, int] = {"": 0}
        self.features: list[tuple[int, ...]] = []

    def ids(self, text: str) -> np.ndarray:
        out = []
        for w in text.split():
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.features)
                names = dict.fromkeys(token_features(w))
                self.features.append((0, *(self.named.setdefault(n, len(self.named)) for n in names if n)))
            out.append(k)
        return np.array(out, np.int64)


def telling_features(words: Words, docs: list[np.ndarray], ys: np.ndarray, least: int, precision: float) -> set[int]:
    """Features (but the first, which every word has) found in `least` toxic documents and nearly only in these."""
    found = (defaultdict(int), defaultdict(int))
    for ids, y in zip(docs, ys, strict=True):
        for f in {f for k in np.unique(ids) for f in words.features[k][1:]}:
            found[y][f] += 1
    odds = max(1, int((ys == 0).sum())) / max(1, int((ys == 1).sum()))
    return {f for f, n in found[1].items() if n >= least and n * odds / (n * odds + found[0][f]) >= precision}


def document_features(p: np.ndarray) -> tuple[float, float, float]:
    """From a document's marginals: the log odds of the largest and of the one after it, and the log of the sum."""
    top = np.full(2, 1e-6)
    top[: min(2, len(p))] = np.sort(p)[::-1][:2] if len(p) <= 2 else np.sort(np.partition(p, len(p) - 2)[-2:])[::-1]
    first, second = np.clip(top, 1e-6, 1 - 1e-6)
    return float(np.log(first / (1 - first))), float(np.log(second / (1 - second))), float(np.log(p.sum() + 1e-4))


def marginals_of(chain: Chain, scores: list[np.ndarray]) -> list[np.ndarray]:
    out = [np.empty(0)] * len(scores)
    for group in blocks(np.array([len(s) for s in scores], dtype=np.int64)):
        matrix, active = padded([scores[k] for k in group], np.float64)
        p = chain.marginals(matrix, active)
        for lane, k in enumerate(group):
            out[k] = p[: len(scores[k]), lane].copy()
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and intercept of a ridge-regularised logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


class Model:
    """weights: of the features that the sample has and that tell states apart; others count as 0."""

    def __init__(self, chain: Chain, names: dict[str, int], calibration: np.ndarray):
        self.weights = {n: float(chain.w[k]) for n, k in names.items() if abs(chain.w[k]) > 1e-3}
        chain.w = chain.w[:1]
        self.chain, self.calibration = chain, calibration

    def score(self, marginals: np.ndarray) -> float:
        z = float(np.dot(self.calibration, [*document_features(marginals), 1.0]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[str, int]], least: int = 4, precision: float = 0.85) -> Model:
    """A model of (text, label) rows; three quarters teach the chain, the rest calibrate it.

    Without a toxic row nothing is known to be toxic: every document is clean and has no spans.
    """
    words = Words()
    if not any(y for _, y in rows):
        chain = Chain(len(words.named))
        chain.w[0] = -30.0
        return Model(chain, words.named, np.array([0.0, 0.0, 0.0, -30.0]))
    docs, ys = [words.ids(t) for t, _ in rows], np.array([y for _, y in rows], np.int64)
    teach = np.arange(len(rows)) % 4 != 3
    taught = [d for d, k in zip(docs, teach, strict=True) if k]
    marks = telling_features(words, taught, ys[teach], least, precision)
    telling = np.array([not marks.isdisjoint(fs[1:]) for fs in words.features], bool)
    chain = Chain(len(words.named))
    sequences, states = [], []
    for ids, y in zip(taught, ys[teach], strict=True):
        z = (telling[ids] if y else np.zeros(len(ids), bool)).astype(np.float64)
        for k in range(0, len(ids), SEGMENT):
            sequences.append(ids[k : k + SEGMENT])
            states.append(z[k : k + SEGMENT])
    if sequences:
        chain.fit(words.features, sequences, states, rounds=40)
    item = np.array([chain.w[list(fs)].sum() for fs in words.features])
    rest = [k for k in range(len(rows)) if not teach[k]] or list(range(len(rows)))
    p = marginals_of(chain, [item[docs[k]] for k in rest])
    x = np.array([document_features(v) for v in p]).reshape(-1, 3)
    return Model(chain, words.named, logistic(x, ys[rest].astype(float)))


class Scores(dict):
    """Emission scores of words, kept while there are fewer than `bound`."""

    def __init__(self, weights: dict[str, float], bound: int = 500_000):
        super().__init__()
        self.weights, self.bound = weights, bound

    def __missing__(self, word: str) -> float:
        if len(self) >= self.bound:
            self.clear()
        w, get = word.lower().strip(EDGES), self.weights.get
        names = {f"={w}", w[:3], w[:4], w[:5], w[:6], w[:7], w[:8], f"-{w[-4:]}", ""}
        value = self[word] = sum([get(n, 0.0) for n in names])
        return value


def spans_of(text: str, p: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Character offsets [start, end) of runs of words whose marginal reaches the threshold."""
    out: list[tuple[int, int]] = []
    if not len(p) or p.max() < threshold:
        return out
    at = 0
    run = False
    for word, hit in zip(text.split(), p >= threshold, strict=True):
        begin = text.index(word, at)
        at = begin + len(word)
        if hit:
            out[-1:] = [(out[-1][0], at)] if run else [*out[-1:], (begin, at)]
        run = bool(hit)
    return out


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, spans (struct start, end in characters) and their number, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    slim, kind = keyed_texts(docs)
    schema = pa.schema([("doc_id", kind), ("score", pa.float64()), ("spans", pa.list_(span)), ("n_spans", pa.int32())])

    def begin():
        m = shared.value
        emission = Scores(m.weights)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = []
            for t in texts:
                w = t.split()
                scores.append(np.fromiter(map(emission.__getitem__, w), np.float64, len(w)))
            p = marginals_of(m.chain, scores)
            spans = [spans_of(t, v, threshold) for t, v in zip(texts, p, strict=True)]
            return {"doc_id": batch.column("doc_id"), "score": [m.score(v) for v in p], "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "n_spans": list(map(len, spans))}

        return work

    return in_batches(slim, schema, begin)


def learned(docs: DataFrame, labels: DataFrame, bound: int = 3000) -> Model:
    """The model fitted on at most `bound` labelled rows outside the held-out fold."""
    return fitted(labelled_rows(docs, labels, "toxic", 4, 2, bound), fit)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 3000, cut: float = CUT) -> DataFrame:
    """Fit on at most `bound` labelled rows outside the held-out fold, then score every document."""
    model = learned(docs, labels, bound)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_spans", "spans")
