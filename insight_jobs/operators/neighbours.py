"""Exact nearest neighbours of all rows of a table by pivots and distance bounds.

Rows go to the nearest of a bounded number of pivots. A first pass looks into a row's own cell, whose k-th distance bounds
the true one. A cell can then hold a neighbour only if the row's distance to its pivot, less the cell's radius, is
within that bound. Cells lie together in parts of bounded size, near ones in one part, large ones dealt into several. A second
pass sends a row once to each part that has such a cell, whatever their number, and keys and distances of k rows at most come
back. Where the bounds rule nothing out all pairs are compared, and what is sent is a row for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from .dense import matrix, runs

FOUND = "id long, other long, away double"
#: Values of a part's vectors, and tasks that are wanted at least.
PART_VALUES, TASKS = 4_000_000, 12


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, without the cancellation of the product form."""
    return ((a[:, None, :] - b[None]) ** 2).sum(2)


def nearest(ids: np.ndarray, x: np.ndarray, mine: np.ndarray, q: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance) of the k nearest rows with another id, ties by id; of those not beyond `within` where given.

    Products tell which rows can count, allowing for their rounding; distances of these are taken without cancellation.
    """
    with np.errstate(all="ignore"):
        middle = x.mean(0)
        a, b = q - middle, x - middle
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        about = aa[:, None] + bb - 2 * (a @ b.T)
        slack = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (aa + bb.max())
        most = min(k, len(x) - 1)  # one more than k, as the row itself may be there
        limit = np.partition(about, most, axis=1)[:, most] + 2 * slack
        if within is not None:
            limit = np.fmin(limit, (within * (1 + 1e-9) + 1e-12) ** 2 + 2 * slack)
    rows, others, aways = [], [], []
    for i in range(len(q)):
        near = np.flatnonzero(~(about[i] > limit[i]))
        near = near[ids[near] != mine[i]]
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[near], d))[:k]
        rows.append(np.full(len(best), i))
        others.append(near[best])
        aways.append(d[best])
    none = [np.empty(0)]
    return np.concatenate(rows or none).astype(int), np.concatenate(others or none).astype(int), np.concatenate(aways or none)


def dealt_cells(pivot: np.ndarray, counts: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of parts) of each cell: cells that follow each other from near to near share parts of part_rows rows."""
    first, parts = np.zeros(len(pivot), int), np.maximum(1, -(-counts // part_rows))
    left, now, at, room = set(range(1, len(pivot))), 0, -1, 0
    while True:
        if parts[now] > 1 or counts[now] > room:
            first[now], at, room = at + 1, at + parts[now], part_rows
        else:
            first[now] = at
        room = 0 if parts[now] > 1 else room - counts[now]
        if not left:
            return first, parts
        some = np.array(sorted(left))
        now = int(some[far(pivot[now : now + 1], pivot[some])[0].argmin()])
        left.remove(now)


def neighbours(rows: DataFrame, k: int, pivots: int = 256, part_rows: int | None = None, vectors: bool = True) -> DataFrame:
    """id, other, away (distance), rank: the k nearest other rows of each; ties by id. With `vectors` also x (the other's vector).

    rows: id (long, each once), x (array of double, one length, no nulls).
    """
    spark = rows.sparkSession
    place = shared.fresh_dir(spark, "neighbours")
    chosen = rows.orderBy(F.xxhash64("x"), "id").limit(pivots).select("x").toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], f"{FOUND}, rank int{', x array<double>' if vectors else ''}")
    pivot = np.unique(matrix(chosen.column("x")), axis=0)
    part_rows = part_rows or max(1000, PART_VALUES // max(1, pivot.shape[1]))
    sent = spark.sparkContext.broadcast(pivot)  # `pivots` rows

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column("x")]))
            cells, aways = [], []
            for start in range(0, len(x), 1000):
                d = far(x[start : start + 1000], sent.value)
                cells.append(d.argmin(1))
                aways.append(np.sqrt(d.min(1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(np.concatenate(cells or [np.empty(0)]).astype(np.int32)), pa.array(np.concatenate(aways or [np.empty(0)]))], names=["id", "x", "cell", "off"])

    home = shared.written(rows.select("id", "x").mapInArrow(placed, "id long, x array<double>, cell int, off double"), f"{place}/home")
    told = {r["cell"]: (r["n"], r["radius"]) for r in home.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()}  # a row a pivot
    counts = np.array([told.get(c, (0, 0.0))[0] for c in range(len(pivot))])
    radius = np.array([told.get(c, (0, 0.0))[1] for c in range(len(pivot))])
    first, parts = dealt_cells(pivot, counts, part_rows)
    of_cell = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
    members = home.withColumn("part", of_cell(first) + F.pmod(F.xxhash64("id"), of_cell(parts)).cast("int"))
    asking = shared.written(bounded(members, k), f"{place}/asking")

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = int((first + parts).max())
        holds = np.zeros((len(pivot), number), bool)
        for c in np.flatnonzero(counts):
            holds[c, first[c] : first[c] + parts[c]] = True
        for batch in batches:
            x, within = matrix(pa.chunked_array([batch.column("x")])), batch.column("bound").to_numpy()
            for start in range(0, len(x), 1000):
                d = np.sqrt(far(x[start : start + 1000], sent.value))
                row, part = np.nonzero(reached(d, radius, within[start : start + 1000]) @ holds)
                some = batch.slice(start, 1000).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *some.columns], names=["part", *some.schema.names])

    every = asking.mapInArrow(asks, "part int, id long, x array<double>, cell int, bound double")
    lanes = max(1, -(-TASKS // int((first + parts).max())))  # copies of a part, among which its askers are dealt
    order = Window.partitionBy("id").orderBy("away", "other")
    best = asked_of(members, every, k, pivot, radius, lanes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if vectors:
        best = best.join(home.select(F.col("id").alias("other"), "x"), "other").select("id", "other", "away", "x", "rank")
    out = shared.written(best, shared.fresh_dir(spark, "nearest"))
    shared.delete(spark, place)
    return out


def reached(away: np.ndarray, radius: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which cells a row can have neighbours in, from its distances to their pivots."""
    return ~(away - radius > within[:, None] * (1 + 1e-9) + 1e-12)


def bounded(members: DataFrame, k: int) -> DataFrame:
    """id, x, cell, bound: the distance of the k-th nearest row in the row's own cell, or the share of it in its part."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for key, some in runs(batches, ["part", "cell"]):
            if key != now and held:
                yield from bounds_of(pa.Table.from_batches(held))
                held = []
            now = key
            held.append(some)
        if held:
            yield from bounds_of(pa.Table.from_batches(held))

    def bounds_of(block: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x = block.column("id").to_numpy(), matrix(block.column("x"))
        at = step(x)
        for start in range(0, len(x), at):
            some = block.slice(start, at).combine_chunks().to_batches()[0]
            rows, _, away = nearest(ids, x, ids[start : start + at], x[start : start + at], k)
            bound = np.zeros(some.num_rows)
            np.maximum.at(bound, rows, away)
            bound[np.bincount(rows, minlength=len(bound)) < k] = np.inf
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("x"), some.column("cell"), pa.array(bound)], names=["id", "x", "cell", "bound"])

    dealt = members.select("part", "cell", "id", "x").repartition("part", "cell").sortWithinPartitions("part", "cell")
    return dealt.mapInArrow(bounds, "id long, x array<double>, cell int, bound double")


def step(x: np.ndarray) -> int:
    """Rows that are compared with x at once, so that their distances stay bounded."""
    return max(1, min(256, PART_VALUES // max(1, len(x))))


def asked_of(members: DataFrame, asking: DataFrame, k: int, pivot: np.ndarray, radius: np.ndarray, lanes: int = 1) -> DataFrame:
    """id, other, away: the k nearest members of each part that a row asks, within its bound."""
    left = members.select("part", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(False).alias("asks"), "cell", "id", "x", F.lit(0.0).alias("bound"))
    right = asking.select("part", F.pmod(F.xxhash64("id", F.lit("lane")), F.lit(lanes)).cast("int").alias("lane"), F.lit(True).alias("asks"), "cell", "id", "x", "bound")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, x, cells, starts = None, [], None, None, None, None
        for (part, lane, asks), some in runs(batches, ["part", "lane", "asks"]):
            if not asks:
                if now != (part, lane) or x is not None:
                    now, held, x = (part, lane), [], None
                held.append(some)
                continue
            if now != (part, lane):
                continue
            if x is None:
                block = pa.Table.from_batches(held)
                ids, x, held = block.column("id").to_numpy(), matrix(block.column("x")), []
                cells, starts = np.unique(block.column("cell").to_numpy(), return_index=True)
            mine, q, bound, at = some.column("id").to_numpy(), matrix(pa.chunked_array([some.column("x")])), some.column("bound").to_numpy(), step(x)
            for start in range(0, len(q), at):
                few = slice(start, start + at)
                wanted = reached(np.sqrt(far(q[few], pivot[cells])), radius[cells], bound[few]).any(0)
                if not wanted.any():
                    continue
                ends = np.append(starts[1:], len(x))
                ring = slice(None) if wanted.all() else np.concatenate([np.arange(a, b) for a, b in zip(starts[wanted], ends[wanted], strict=True)])
                rows, others, away = nearest(ids[ring], x[ring], mine[few], q[few], k, bound[few])
                yield pa.RecordBatch.from_arrays([pa.array(mine[few][rows]), pa.array(ids[ring][others]), pa.array(away)], names=["id", "other", "away"])

    return left.union(right).repartition("part", "lane").sortWithinPartitions("part", "lane", "asks", "cell").mapInArrow(answers, FOUND)
