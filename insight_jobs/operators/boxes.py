"""Text blocks near images of their page, without pairs of all.

The blocks of a page, or a bounded part of a large page's, lie sorted by their edges and middles; each image looks at those next
to it until no farther one can count. What leaves is a row for each image and part.

A block's place among those of its page tells which of equally near ones counts, so blocks come in the order of block_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import SENT_SCOPES, runs

SIDES = ("x0", "y0", "x1", "y1")
KINDS = ("under", "over", "side1", "side2", "near")


class Page:
    """Boxes of blocks, in the order of block_id; missing sides are NaN."""

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, below: float, above: float, beside: float):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1
        self.below, self.above, self.beside = below, above, beside
        self.middle = (y0 + y1) / 2
        self.by_top, self.tops = self.ordered(y0)
        self.by_bottom, self.bottoms = self.ordered(-y1)
        self.by_middle, self.middles = self.ordered(self.middle)
        self.tallest = np.nanmax(y1 - y0, initial=0.0)

    @staticmethod
    def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(values, kind="stable")
        order = order[~np.isnan(values[order])]
        return order, values[order]

    @staticmethod
    def first(order: np.ndarray, away, counts) -> tuple[float, int] | None:
        """The least (distance, place) that counts, of blocks in an order in which distances don't fall."""
        best, at, size = None, 0, 32
        while at < len(order):
            some = order[at : at + size]
            d = away(some)
            good = counts(some, d)
            if good.any():
                least = d[good].min()
                here = float(least), int(some[good & (d == least)].min())
                best = min(best, here) if best else here
            if best and d[-1] > best[0]:
                break
            at, size = at + size, size * 2
        return best

    def around(self, x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, int] | None]:
        """(distance, place) of the block under, over, two beside and nearest to a box."""
        middle = (y0 + y1) / 2

        def over(some: np.ndarray) -> np.ndarray:
            wide = np.fmin(x1, self.x1[some]) - np.fmax(x0, self.x0[some])
            return np.where(wide <= 0, 0.0, wide / np.fmax(self.x1[some] - self.x0[some], 1.0)) > 0.2

        far = lambda some: np.abs(self.middle[some] - middle)
        under = self.by_top[np.searchsorted(self.tops, y1) : np.searchsorted(self.tops, y1 + self.below + 1, "right")]
        above = self.by_bottom[np.searchsorted(self.bottoms, -y0) : np.searchsorted(self.bottoms, self.above + 1 - y0, "right")]
        at = np.searchsorted(self.middles, middle)
        any_ = lambda some, d: ~np.isnan(d)
        ends = [self.first(side, far, any_) for side in (self.by_middle[at:], self.by_middle[:at][::-1])]
        near = min((e for e in ends if e), default=None)
        first = self.first(under, lambda some: self.y0[some] - y1, lambda some, d: (d >= 0) & (d <= self.below) & over(some))
        last = self.first(above, lambda some: y0 - self.y1[some], lambda some, d: (d >= 0) & (d <= self.above) & over(some))
        return [first, last, *self.both_sides(x0, y0, x1, y1, middle, at), near]

    def both_sides(self, x0: float, y0: float, x1: float, y1: float, middle: float, at: int) -> list[tuple[float, int] | None]:
        """The two nearest of those beside the box: such a block's middle is no farther than both heights allow."""
        most = (self.tallest + (y1 - y0)) / 2 + 1
        low, high = np.searchsorted(self.middles, middle - most), np.searchsorted(self.middles, middle + most, "right")
        size = 64
        while True:
            begin, end = max(low, at - size), min(high, at + size)
            some = self.by_middle[begin:end]
            tall = np.fmin(y1, self.y1[some]) - np.fmax(y0, self.y0[some])
            right, left = self.x0[some] - x1, x0 - self.x1[some]
            beside = (tall > 20) & (((right >= 0) & (right <= self.beside)) | ((left >= 0) & (left <= self.beside)))
            some = some[beside]
            d = np.abs(self.middle[some] - middle)
            edge = min(middle - self.middles[begin - 1] if begin > low else np.inf, self.middles[end] - middle if end < high else np.inf)
            if (d < edge).sum() >= 2 or (begin <= low and end >= high):
                best = np.lexsort((some, d))[:2]
                return [*[(float(d[b]), int(some[b])) for b in best], None, None][:2]
            size *= 4


def blocks_near(images: DataFrame, texts: DataFrame, below: float, above: float, beside: float, part_rows: int = 50_000) -> DataFrame:
    """doc_id, page, img_id and under, over, side1, side2, near (structs of d, b, t: distance, block_id and text), a row for each image.

    images: doc_id, page, img_id, x0, y0, x1, y1; texts: doc_id, page, block_id, x0, y0, x1, y1, text. Pages of more than part_rows texts
    are dealt into parts, to each of which their images go.
    """
    keys = ["doc_id", "page"]
    texts = texts.where("doc_id IS NOT NULL AND page IS NOT NULL")
    large = texts.groupBy(*keys).count().where(F.col("count") > part_rows).select(*keys, F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    some = large.limit(SENT_SCOPES + 1).toArrow()
    if some.num_rows:
        if some.num_rows <= SENT_SCOPES:
            large = F.broadcast(texts.sparkSession.createDataFrame(some.to_pylist(), large.schema))  # SENT_SCOPES rows at most
        texts, images = texts.join(large, keys, "left"), images.join(large, keys, "left")
        texts = texts.withColumn("part", F.coalesce(F.pmod(F.xxhash64("block_id"), F.col("parts")).cast("int"), F.lit(0)))
        images = images.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    else:
        texts, images = (df.withColumn("part", F.lit(0)) for df in (texts, images))
    types = dict(images.dtypes) | {"block_id": dict(texts.dtypes)["block_id"]}
    box = [F.col(c).cast("double").alias(c) for c in SIDES]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = texts.select(*keys, "part", F.lit(False).alias("asks"), "block_id", none("img_id", types["img_id"]), *box, "text")
    right = images.select(*[F.col(c).cast(dict(texts.dtypes)[c]).alias(c) for c in keys], "part", F.lit(True).alias("asks"), none("block_id", types["block_id"]), "img_id", *box, none("text", "string"))
    sides = lambda rows: [rows.column(c).fill_null(np.nan).to_numpy() for c in SIDES]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, there = None, [], None, None
        for (doc, page, part, asks), rows in runs(batches, [*keys, "part", "asks"]):
            if not asks:
                if now != (doc, page, part) or block is not None:
                    now, held, block = (doc, page, part), [], None
                held.append(rows)
                continue
            if now != (doc, page, part):
                now, held, block, there = (doc, page, part), [rows.slice(0, 0)], None, None
            if block is None:
                block = pa.Table.from_batches(held)
                there, held = Page(*sides(block), below, above, beside), []
            found = [there.around(*b) for b in zip(*sides(rows), strict=True)]
            out = [rows.column(c) for c in (*keys, "img_id", "part", *SIDES)]
            for kind in range(len(KINDS)):
                at = pa.array([f[kind][1] if f[kind] else None for f in found], pa.int64())
                d = pa.array([f[kind][0] if f[kind] else None for f in found], pa.float64())
                parts = [d, *[block.column(c).combine_chunks().take(at) if block.num_rows else pa.nulls(len(found), block.schema.field(c).type) for c in ("block_id", "text")]]
                out.append(pa.StructArray.from_arrays(parts, ["d", "b", "t"], mask=at.is_null()))
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "img_id", "part", *SIDES, *KINDS])

    met = left.unionByName(right)
    fields = [f"{c} {dict(met.dtypes)[c]}" for c in (*keys, "img_id", "part", *SIDES)] + [f"{k} struct<d:double,b:{types['block_id']},t:string>" for k in KINDS]
    dealt = met.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "asks", "block_id", "text")
    found = dealt.mapInArrow(answers, ", ".join(fields))
    if some.num_rows:
        two = F.slice(F.array_sort(F.filter(F.flatten(F.collect_list(F.array("side1", "side2"))), lambda s: s.isNotNull())), 1, 2)  # two a part
        copies = F.count_if(F.col("part") == 0)
        merged = found.groupBy(*keys, "img_id", *SIDES).agg(F.min("under").alias("under"), F.min("over").alias("over"), two.alias("two"), F.min("near").alias("near"), copies.alias("copies"))
        found = merged.select("*", F.get("two", F.lit(0)).alias("side1"), F.get("two", F.lit(1)).alias("side2"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return found.select(*keys, "img_id", *KINDS)
