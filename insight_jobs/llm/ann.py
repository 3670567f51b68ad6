"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors get one more component, so that the largest inner product becomes the nearest direction; a principal-axes
projection and an iteratively fitted rotation, learned on a bounded sample, turn each into 64 bits. Every vector's code
is cut into four substrings of 16 bits, each indexed by its value. A query probes each index at growing distances: if
all values at distance r or less are probed in all four, every code within 4r + 3 bits has been found (pigeonhole).
It stops at the least such radius that holds enough codes, and reranks exactly these by their inner products.

Vectors are dealt by a hash into blocks of bounded size and queries into groups of bounded size; each pair of a block
and a group is one task, which builds the block's index once for all queries of the group, and a query's best of every
block are merged. Groups are as large as memory allows, so that a block is sent as few times as it can be.

Vectors that are null, empty, of another length than most, zero, or hold null or non-finite components take no part,
nor do rows without vec_id. Of several rows with one vec_id the smallest vector counts, once. Ties go to the smaller
vec_id. Scores are inner products of the vectors as given, in double precision. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BITS, PARTS, WIDTH = 64, 4, 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of float or double, as given) of the vectors that take part, one for each vec_id."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = dict(vectors.dtypes)["embedding"]
    kept = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long"), kept.alias("v"))
    single = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    return single.join(F.broadcast(common), F.size("v") == F.col("dim"), "left_semi")  # one row


class Coder:
    """Mean, projection to 64 axes with a fitted rotation, and the length of the longest vector."""

    def __init__(self, sample: np.ndarray, longest: float, rounds: int = 30, seed: int = 3):
        self.longest = longest
        x = self.lifted(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        axes = np.linalg.svd(x, full_matrices=False)[2][:BITS]
        project = np.zeros((x.shape[1], BITS))
        project[:, : len(axes)] = axes.T
        rotate = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS, BITS)))[0]
        y = x @ project
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(y @ rotate > 0, 1.0, -1.0).T @ y)
            rotate = (u @ w).T
        self.matrix = project @ rotate

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))])

    def parts(self, lifted: np.ndarray) -> np.ndarray:
        """Codes as four numbers of 16 bits for each row."""
        bits = (lifted - self.mean) @ self.matrix > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.int64)

    def base(self, x: np.ndarray) -> np.ndarray:
        return self.parts(self.lifted(x))

    def query(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return self.parts(np.column_stack([unit, np.zeros(len(x))]))


def _by_weight() -> list[np.ndarray]:
    values = np.arange(1 << WIDTH)
    weight = np.bitwise_count(values)
    return [values[weight == r] for r in range(WIDTH + 1)]


class Index:
    """The four substring indexes of a block."""

    def __init__(self, codes: np.ndarray):
        self.whole = self.joined(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.begin = [np.searchsorted(codes[o, j], np.arange((1 << WIDTH) + 1)) for j, o in enumerate(self.order)]
        self.masks = _by_weight()

    @staticmethod
    def joined(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for j in range(PARTS):
            out = (out << np.uint64(WIDTH)) | codes[:, j].astype(np.uint64)
        return out

    def within(self, code: np.ndarray, enough: int) -> np.ndarray:
        """Rows of all codes within the least probed radius that holds `enough` of them."""
        whole = self.joined(code[None])[0]
        seen = np.zeros(len(self.whole), bool)
        for r in range(WIDTH + 1):
            for j in range(PARTS):
                values = self.masks[r] ^ code[j]
                low, high = self.begin[j][values], self.begin[j][values + 1]
                size = high - low
                full = size > 0
                low, size = low[full], size[full]
                at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                seen[self.order[j][at]] = True
            rows = np.flatnonzero(seen)
            if len(rows) < enough and r < WIDTH:
                continue
            rows = rows[np.bitwise_count(self.whole[rows] ^ whole) <= 4 * r + 3]
            if len(rows) >= enough or r == WIDTH:
                break
        return rows


def search_block(coder: Coder, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, share: float) -> pa.Table:
    """Each query's k best of the block."""
    index, x32 = Index(coder.base(x)), x.astype(np.float32)
    enough = min(len(ids), max(50 * k, int(np.ceil(share * len(ids)))))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for query_id, code, v in zip(query_ids, coder.query(q), q, strict=True):
        rows = index.within(code, enough)
        rows = rows[ids[rows] != query_id]
        size = float(np.abs(v).sum())
        if len(rows) > k and coder.longest * size < 1e30:
            rough = x32[rows] @ v.astype(np.float32)
            slack = 2e-5 * coder.longest * size
            rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        score = x[rows] @ v
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), query_id), ids[rows][best], score[best]))
    return pa.table({name: np.concatenate([o[c] for o in out]) for c, name in enumerate(("query_id", "vec_id", "score"))})


def matrix_of(rows: pa.Table) -> np.ndarray:
    """The vectors of a table's rows, which have one length."""
    return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, share: float = 0.2, block_rows: int = 12_000, group_rows: int = 24_000, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all other vectors.

    share: of a block's codes at least so many must lie in the radius that a query ends at.
    """
    rows = staged(usable(vectors))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("largest")).first()
    schema = "query_id long, vec_id long, score double"
    if not facts["n"]:
        found = vectors.sparkSession.createDataFrame([], schema)
    else:
        part = lambda x: x.cast("double") / F.lit(facts["largest"])
        longest = facts["largest"] * rows.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + part(b) * part(b))))).first()[0]
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
        coder = vectors.sparkSession.sparkContext.broadcast(Coder(matrix_of(sample), longest))
        blocks, groups = -(-facts["n"] // block_rows), -(-rows.where(is_query).count() // group_rows)
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, groups)))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
        base = rows.select("vec_id", "v", F.lit(False).alias("asks"), block.cast("long").alias("block"), every(groups).alias("grp"))
        asked = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("asks"), every(blocks).alias("block"), group.cast("long").alias("grp"))

        def run(dealt: pa.Table) -> pa.Table:
            left, right = dealt.filter(pc.invert(dealt.column("asks"))), dealt.filter(dealt.column("asks"))
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return search_block(coder.value, left.column("vec_id").to_numpy(), matrix_of(left), right.column("vec_id").to_numpy(), matrix_of(right), k, share)

        found = base.union(asked).groupBy("block", "grp").applyInArrow(lambda dealt: run(dealt), schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
