"""Hard negatives by bounds along a spanning tree of the anchors.

Vectors become whole numbers, so that scores (inner products) are exact. Anchors are joined into groups of bounded size, near
ones together, and each group into a least spanning tree. For a candidate x, the score of an anchor c differs from that of its
parent p by <c - p, x>, which is at most the edge's length times the length of x. So one exact score at the root gives
bounds at every anchor, kept along the tree; a candidate is rescored at an anchor only where its bounds overlap what the anchor
still wants: the best k of its label at first, then the window of negative scores of each of its positives, and nothing
under the best that are known already. Where bounds overlap nothing, no score is computed; where they do, it is exact, and
the children start from it.

Candidates are dealt into blocks of bounded size once. A task reads a block and then streams the groups of anchors by it, so
that it holds one block and one group; each block's best are merged. What a task sends is bounded by k for each anchor and
positive.

Rows with a null vec_id, label or vector, a null or non-finite component, or a vector of another length than most take no
part. Of several rows with one vec_id the smallest vector counts, then the smallest label. Ties go to the smaller vec_id. An
empty table, or one without anchors, gives an empty result. Scores that a double can't hold exactly are computed by Python's
whole numbers; one that no long holds is an error. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from .common import dropped, staged

SCALE = 256
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, x (array of double, whole numbers) of the rows that take part, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.when(F.abs(c * SCALE) < EXACT, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    single = rows.select(F.col("vec_id").cast("long"), F.struct(whole.alias("x"), label.cast("long").alias("label")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    out = single.select("vec_id", "r.label", "r.x").join(F.broadcast(common), F.size("x") == F.col("dim"), "left_semi")  # one row
    return out.select("vec_id", "label", "x")


def spanning_tree(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(order, parent) of a least spanning tree from row 0 on, whose parent is -1.

    The order goes depth first, a row's largest branch last, so that a walk holds few rows with branches still to come: at
    most the logarithm of their number.
    """
    n = len(x)
    parent, joined = np.zeros(n, np.int64), [0]
    parent[0] = -1
    square = (x * x).sum(1)
    away = np.full(n, np.inf)
    todo = np.ones(n, bool)
    todo[0] = False
    for _ in range(n - 1):
        new = np.maximum(square + square[joined[-1]] - 2 * (x @ x[joined[-1]]), 0.0)
        nearer = todo & (new < away)
        parent[nearer], away[nearer] = joined[-1], new[nearer]
        left = np.flatnonzero(todo)
        at = int(left[away[left].argmin()])
        joined.append(at)
        todo[at] = False
    size = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for at in reversed(joined[1:]):
        size[parent[at]] += size[at]
        children[parent[at]].append(at)
    order, stack = [], [0]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += sorted(children[at], key=lambda c: -size[c])
    return order, parent


def vectors_of(part: pa.Table) -> np.ndarray:
    return part.column("x").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)


class Block:
    """Candidates of one block: ids, labels, vectors and the length of each."""

    def __init__(self, part: pa.Table):
        ids, labels, x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), vectors_of(part)
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.size = np.sqrt((self.x * self.x).sum(1)) * (1 + 1e-12)
        self.longest = float(self.size.max(initial=0.0))

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.longest * float(np.linalg.norm(anchor)) < EXACT / 2:
            return self.x[rows] @ anchor
        whole = list(map(int, anchor))
        return np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in self.x[rows]], object)


class Group:
    """Anchors in the order of their tree: ids, labels, vectors and each one's parent (-1 at the root)."""

    def __init__(self, part: pa.Table):
        self.ids, self.labels, self.parent = (part.column(c).to_numpy() for c in ("vec_id", "label", "parent"))
        self.x = vectors_of(part)
        self.more = part.column("more").to_pylist()


class Walk:
    """Bounds of a block's rows along the tree of a group of anchors; counts what was rescored."""

    def __init__(self, block: Block, group: Group):
        self.block, self.group, self.rescored = block, group, 0

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, low, high): bounds of the rows' scores there, to be narrowed by `exact`."""
        x, parent = self.group.x, self.group.parent
        children = np.bincount(parent[parent >= 0], minlength=len(parent))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at, up in enumerate(parent.tolist()):
            if up < 0:
                low = self.block.scores(slice(None), x[at])
                high = low.copy()
                self.rescored += len(low)
            else:
                low, high = bounds[up]
                children[up] -= 1
                if not children[up]:
                    del bounds[up]
                edge = float(np.linalg.norm(x[at] - x[up])) * (1 + 1e-12)
                if edge:
                    reach = edge * self.block.size + 1e-9 * (1 + np.abs(low).astype(float))  # more than rounding can hide
                    low, high = low - reach, high + reach
                else:  # known scores stay the whole numbers that they are
                    low, high = low.copy(), high.copy()
            yield at, low, high
            if children[at]:
                bounds[at] = low, high

    def exact(self, at: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted rows; those whose bounds have met are known already."""
        apart = wanted[low[wanted] < high[wanted]]
        if len(apart):
            low[apart] = high[apart] = self.block.scores(apart, self.group.x[at])
            self.rescored += len(apart)
        return low[wanted]


def best_of_label(block: Block, group: Group, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): each anchor's best k other rows of its label in the block."""
    begin, end = (np.searchsorted(block.labels, group.labels, side) for side in ("left", "right"))
    walk = Walk(block, group)
    for at, low, high in walk:
        rows = np.arange(begin[at], end[at])
        rows = rows[block.ids[rows] != group.ids[at]]
        if len(rows) > k:
            rows = rows[high[rows] >= np.partition(low[rows], len(rows) - k)[len(rows) - k]]
        score = walk.exact(at, low, high, rows)
        best = np.lexsort((block.ids[rows], -score))[:k]
        yield at, rows[best], score[best]


def best_in_windows(block: Block, group: Group, k: int, window: tuple[int, int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive's place, rows, scores): the best k rows of other labels in the window of each positive's score.

    window: least, whole and most; a score s suits a positive of score p if least * p <= whole * s <= most * p.
    """
    least, whole, most = window
    walk = Walk(block, group)
    for at, low, high in walk:
        other = block.labels != group.labels[at]
        wanted = np.zeros(len(other), bool)
        for p in set(group.more[at]):
            inside = other & (whole * high >= least * p) & (whole * low <= most * p)
            sure = inside & (whole * low >= least * p) & (whole * high <= most * p)
            if np.count_nonzero(sure) > k:
                inside &= high >= np.partition(low[sure], -k)[-k]
            wanted |= inside
        rows = np.flatnonzero(wanted)
        score = walk.exact(at, low, high, rows)
        for place, p in enumerate(group.more[at], 1):
            fits = np.flatnonzero((whole * score >= least * p) & (whole * score <= most * p))
            best = fits[np.lexsort((block.ids[rows[fits]], -score[fits]))[:k]]
            yield at, place, rows[best], score[best]


def anchor_groups(anchors: DataFrame, most: int, pivots: int = 64) -> DataFrame:
    """Add `grp`, `place` and `parent`: groups of about `most` anchors, near ones together, and the tree of each.

    Anchors go to the nearest of at most `pivots` of them; small neighbourhoods share a group, large ones are cut by a hash. The
    pivots are few rows, and so are the counts by pivot.
    """
    chosen = np.array([r["x"] for r in anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("x").collect()])
    half = (chosen * chosen).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, chosen.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ chosen.T - half).argmax(1).astype(np.int32))], names=[*batch.schema.names, "pivot"])

    placed = staged(anchors.mapInArrow(nearest, f"{', '.join(f'{c} {t}' for c, t in anchors.dtypes)}, pivot int"))
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}
    first, cuts, group, room = {}, {}, 0, most
    for pivot in sorted(counts):
        cuts[pivot] = -(-counts[pivot] // most)
        if counts[pivot] > room:
            group, room = group + 1, most
        first[pivot] = group
        room -= counts[pivot]
        if cuts[pivot] > 1:
            group, room = group + cuts[pivot], most
    at = lambda told: F.element_at(F.create_map(*[F.lit(y) for kv in told.items() for y in kv]), F.col("pivot"))  # noqa: E731  64 entries at most
    grouped = placed.withColumn("grp", (at(first) + F.pmod(F.xxhash64("vec_id", F.lit(2)), at(cuts))).cast("long")).drop("pivot")

    def trees(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        order, parent = spanning_tree(vectors_of(part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parent < 0, -1, place[parent])
        return part.append_column("place", pa.array(place)).append_column("parent", pa.array(up))

    return grouped.groupBy("grp").applyInArrow(lambda part: trees(part), f"{', '.join(f'{c} {t}' for c, t in grouped.dtypes)}, place long, parent long")


def streamed(rows: DataFrame, asked: DataFrame, block_rows: int, schema: pa.Schema, answer: Callable[[Block, Group], list]) -> DataFrame:
    """Deal candidates into blocks and send every group of anchors past each; `answer` gives the output columns.

    asked: as anchor_groups gives it, and `more` (array of long). A partition is sorted so that a block's candidates come
    first and its anchors follow group by group.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    none = F.lit(-1).cast("long")
    base = rows.select("vec_id", "label", "x", none.alias("grp"), none.alias("place"), none.alias("parent"), F.array().cast("array<long>").alias("more"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long").alias("block"))
    dealt = base.union(asked.select("vec_id", "label", "x", "grp", "place", "parent", "more", every.alias("block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for (number, group), part in runs(batches, ["block", "grp"]):
            if group < 0:
                at, block = number, Block(part)
            elif at == number:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(answer(block, Group(part)), schema, strict=True)], schema=schema)

    return dealt.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "grp", "place").mapInArrow(run, from_arrow_schema(schema))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys, as one table."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        marks = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            mark = tuple(marks[a].tolist())
            if mark != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = mark
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def columns(parts: list[tuple], width: int) -> list[np.ndarray]:
    """Joined columns of parts, as longs."""
    return [np.concatenate([np.empty(0, np.int64), *[np.asarray(p[c]).astype(np.int64) for p in parts]]) for c in range(width)]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 100, 95), block_rows: int = 8_000, group_rows: int = 2_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label: the label that counts, of a row whose own label isn't null. window: as in best_in_windows.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = staged(usable(vectors, label))
    anchors = rows.where(is_anchor)
    if anchors.isEmpty():
        dropped(rows)
        return vectors.sparkSession.createDataFrame([], schema)
    grouped = staged(anchor_groups(anchors, group_rows))

    def alike(block: Block, group: Group) -> list[np.ndarray]:
        return columns([(np.full(len(r), group.ids[at]), block.ids[r], s) for at, r, s in best_of_label(block, group, positives)], 3)

    near = streamed(rows, grouped.withColumn("more", F.array().cast("array<long>")), block_rows, longs("anchor_id", "positive_id", "positive_score"), alike)
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")))
    found = staged(placed.where(F.col("place") <= positives))
    told = found.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda r: r["positive_score"]).alias("more"))  # a few each
    asked = grouped.join(told.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def unlike(block: Block, group: Group) -> list[np.ndarray]:
        return columns([(np.full(len(r), group.ids[at]), np.full(len(r), place), block.ids[r], s) for at, place, r, s in best_in_windows(block, group, negatives, window)], 4)

    hits = streamed(rows, asked, block_rows, longs("anchor_id", "place", "negative_id", "negative_score"), unlike)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")))
    out = ranked.where(F.col("rank") <= negatives).join(found.withColumn("place", F.col("place").cast("long")), ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


#: The registered query in SQL: all anchors against all rows.
ORACLE = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
         CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), negative AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 3
"""
