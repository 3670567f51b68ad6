"""Dense search: exact by blocks, within scopes or over all vectors, and by cells of a stored index.

Vectors and questions meet in units: a scope, or a part of a large one. A task reads the vectors of a unit, which are bounded
in number, and then streams the unit's questions past them; small scopes share a task. What leaves a unit is k rows a question.

Similarity is the cosine, in double precision; ties go to the smaller chunk_id. Vectors and questions that are null, empty or of
another length than most vectors are left out; so are null scopes. A vector of zeros has similarity 0 with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared

#: Large scopes of which the numbers of parts are sent to every task; beyond, they are joined.
SENT_SCOPES = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def plain_vectors(part: pa.Table) -> np.ndarray:
    return unit(matrix(part.column("embedding")))


def of_one_length(vectors: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without rows whose embedding is null, empty or of another length than most vectors."""
    size = F.size("embedding")
    common = vectors.where(F.col("embedding").isNotNull() & (size > 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 0
    return tuple(df.where(F.col("embedding").isNotNull() & (size == d) & F.forall("embedding", lambda x: x.isNotNull())) for df in (vectors, questions))


def with_parts(vectors: DataFrame, questions: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Add `part`: vectors of large scopes are dealt into parts of about block_rows, questions go to every part of their scope."""
    large = vectors.groupBy("scope").count().where(F.col("count") > block_rows).select("scope", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    some = large.limit(SENT_SCOPES + 1).toArrow()
    if some.num_rows <= SENT_SCOPES:
        large = F.broadcast(vectors.sparkSession.createDataFrame(some.to_pylist(), large.schema))  # SENT_SCOPES rows at most
    part = F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return vectors.join(large, "scope", "left").withColumn("part", part).drop("parts"), questions.join(large, "scope", "left").withColumn("part", every).drop("parts")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches within which the keys are equal."""
    for batch in batches:
        change = np.zeros(batch.num_rows, bool)
        marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield tuple(m[a] for m in marks), batch.slice(a, b - a)


def best_in_units(vectors: DataFrame, questions: DataFrame, k: int, vectors_of: Callable[[pa.Table], np.ndarray] = plain_vectors, block_rows: int = 20_000, group_rows: int = 256) -> DataFrame:
    """question_id, chunk_id, score: each question's k best of every unit of its scope.

    vectors: scope, chunk_id and what `vectors_of` makes unit vectors of; questions: scope, question_id, embedding.
    """
    base, asked = with_parts(vectors, questions, block_rows)
    kinds = dict(questions.dtypes)["question_id"], dict(vectors.dtypes)["chunk_id"]
    more = [c for c in base.columns if c not in ("scope", "chunk_id", "part", "embedding")]
    v = F.col("embedding").cast("array<double>") if "embedding" in base.columns else F.lit(None).cast("array<double>")
    left = base.select("scope", "part", F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("question_id"), "chunk_id", v.alias("embedding"), *more)
    right = asked.select("scope", "part", F.lit(True).alias("asks"), "question_id", F.lit(None).cast(kinds[1]).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), *[F.lit(None).cast(dict(base.dtypes)[c]).alias(c) for c in more])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, x = None, [], None, None
        for (scope, part, asks), rows in runs(batches, ["scope", "part", "asks"]):
            if not asks:
                if now != (scope, part) or x is not None:
                    now, held, x = (scope, part), [], None
                held.append(rows)
                continue
            if now != (scope, part):
                continue
            if x is None:
                block = pa.Table.from_batches(held)
                ids, x, held = block.column("chunk_id").combine_chunks(), vectors_of(block), []
            for start in range(0, rows.num_rows, group_rows):
                some = pa.Table.from_batches([rows.slice(start, group_rows)])
                score = plain_vectors(some) @ x.T
                most = min(k, score.shape[1])
                least = np.partition(score, -most, axis=1)[:, -most]
                asked_at, at, got = [], [], []
                for i, row in enumerate(score):
                    near = np.flatnonzero(row >= least[i])
                    best = near[np.argsort(-row[near], kind="stable")[:most]]
                    asked_at.append(np.full(len(best), i))
                    at.append(best)
                    got.append(row[best])
                yield pa.RecordBatch.from_arrays([some.column("question_id").combine_chunks().take(pa.array(np.concatenate(asked_at))), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(got))], names=["question_id", "chunk_id", "score"])

    dealt = left.unionByName(right).repartition("scope", "part").sortWithinPartitions("scope", "part", "asks", "chunk_id")
    return dealt.mapInArrow(answers, f"question_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(questions: DataFrame, vectors: DataFrame, k: int, scope: str | None = None, block_rows: int = 20_000, group_rows: int = 256) -> DataFrame:
    """question_id, chunk_id, score, rank: the k vectors most similar to every question, among all or those of its scope.

    scope: a column of both tables; a question that is asked of several scopes is a row for each and gets its best of all.
    """
    some, asked = of_one_length(vectors, questions)
    within: Column = F.col(scope) if scope else F.lit(0)
    base = some.select(within.alias("scope"), "chunk_id", "embedding").where("scope IS NOT NULL")
    return ranked(best_in_units(base, asked.select(within.alias("scope"), "question_id", "embedding").where("scope IS NOT NULL"), k, block_rows=block_rows, group_rows=group_rows), k)


def centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of spherical k-means; an empty cell takes the vector that is worst placed."""
    x = unit(sample)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = x @ c.T
        cell = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        c = unit(sums)
    return c


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """Store an inverted file of cells under `path`; returns its centres (cell, centre, n).

    Centres are fitted on at most `sample_rows` vectors, chosen by a hash of chunk_id, and number the square root of the vectors
    (4096 at most); every vector is placed. <path>/codes has the vector less its centre in a byte an entry, by which cells are
    searched; <path>/vectors the vectors themselves. Both are folders by cell.
    """
    spark = vectors.sparkSession
    fine, _ = of_one_length(vectors, vectors)
    rows = fine.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).select("embedding").toArrow()
    if not sample.num_rows:
        raise ValueError("no vectors to index")
    n = rows.count()
    middle = centres(matrix(sample.column("embedding")), min(cells or int(np.ceil(np.sqrt(n))), 4096, sample.num_rows))
    sent = spark.sparkContext.broadcast(middle)  # 4096 centres at most
    kind = dict(rows.dtypes)["chunk_id"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(pa.chunked_array([batch.column("embedding")])))
            cell = (x @ sent.value.T).argmax(1).astype(np.int32)
            rest = x - sent.value[cell]
            step = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.rint(rest / step[:, None]).astype(np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("embedding"), lists, pa.array(step), pa.array(cell)], names=["chunk_id", "embedding", "code", "step", "cell"])

    dealt = shared.written(rows.mapInArrow(placed, f"chunk_id {kind}, embedding array<double>, code array<tinyint>, step double, cell int"), f"{path}/placed")
    dealt.select("cell", "chunk_id", "code", "step").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    dealt.select("cell", "chunk_id", "embedding").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    spark.createDataFrame([(i, c.tolist(), counts.get(i, 0)) for i, c in enumerate(middle)], "cell int, centre array<double>, n long").write.parquet(f"{path}/centres")
    shared.delete(spark, f"{path}/placed")
    return spark.read.parquet(f"{path}/centres")


def dense_topk_cells(spark: SparkSession, questions: DataFrame, path: str, k: int, share: float = 0.6, refine: int = 4) -> DataFrame:
    """question_id, chunk_id, score, rank by the index under `path`, approximately.

    A question looks into the nearest cells that hold `share` of all vectors (and k at least); their codes name refine * k
    candidates, whose vectors give the scores. Cells that no question looks into aren't read.
    """
    told = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    middle, held = matrix(told.column("centre")), told.column("n").to_numpy()
    sent = spark.sparkContext.broadcast((middle, held))  # 4096 centres at most
    codes, stored = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors")
    kind = dict(questions.dtypes)["question_id"]
    fine = questions.where(F.col("embedding").isNotNull() & (F.size("embedding") == middle.shape[1]) & F.forall("embedding", lambda x: x.isNotNull()))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, n = sent.value
        least = max(k, share * n.sum())
        for batch in batches:
            order = np.argsort(-(plain_vectors(pa.Table.from_batches([batch])) @ centre.T), axis=1, kind="stable")
            many = (np.cumsum(n[order], axis=1) < least).sum(1) + 1
            at = np.repeat(np.arange(len(order)), np.minimum(many, order.shape[1]))
            cell = np.concatenate([o[:m] for o, m in zip(order, many, strict=True)] or [np.empty(0, int)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("question_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(cell)], names=["question_id", "embedding", "scope"])

    asked = fine.select("question_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(probes, f"question_id {kind}, embedding array<double>, scope int")
    cells = [r["scope"] for r in asked.select("scope").distinct().collect()]  # 4096 at most

    def decoded(part: pa.Table) -> np.ndarray:
        return sent.value[0][part.column("cell").to_numpy()] + matrix(part.column("code")) * part.column("step").to_numpy()[:, None]

    base = codes.where(F.col("cell").isin(cells)).select(F.col("cell").alias("scope"), "chunk_id", "code", "step", "cell")
    near = ranked(best_in_units(base, asked, refine * k, decoded), refine * k).select("question_id", "chunk_id")
    pairs = near.join(stored.where(F.col("cell").isin(cells)).select("chunk_id", F.col("embedding").alias("v")), "chunk_id").join(fine.select("question_id", F.col("embedding").cast("array<double>").alias("q")), "question_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda a: F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return ranked(pairs.select("question_id", "chunk_id", (dot("q", "v") / (length("q") * length("v"))).alias("score")), k)


def share_read(spark: SparkSession, path: str, questions: DataFrame, share: float = 0.6) -> float:
    """The part of the vectors that a question looks into, on average (a cell is read whole)."""
    told = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    centre, n = matrix(told.column("centre")), told.column("n").to_numpy()
    order = np.argsort(-(plain_vectors(questions.select("embedding").limit(1000).toArrow()) @ centre.T), axis=1, kind="stable")
    taken = np.cumsum(n[order], axis=1)
    many = (taken < share * n.sum()).sum(1)
    return float(taken[np.arange(len(order)), many].mean() / n.sum())
