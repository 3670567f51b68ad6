"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by a hash of doc_id, source, length, cluster and a number among equal rows into blocks of bounded size,
so that each task packs some thousand pieces, copies of one text or of one row are spread over all blocks, and the bins
don't hang on how the table is partitioned. Within a block pieces go in, largest first, into the tightest bin
that has room and no conflict: bins are kept in the order of their room, and the search walks from the first with
room to the next larger until a compatible one is found; a new bin is opened only where there is none. A bin carries
a bitmap of its sources (each source has `per_source` bits, one for each piece it may put there) and one of its
duplicate clusters (one bit each; equal texts are a cluster, or what the caller names). A document longer than a bin is cut: its full pieces
fill bins of their own, and the rest is packed like any other.

A null or empty text is one piece of size 1 (the end mark) and in no cluster. Rows with a null source share one source. Repeated rows
are packed one by one. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import told_apart

SCHEMA = "doc_id long, piece int, start long, size int, bin_id long, bin_offset int, source string"


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; sources and clusters are small numbers, cluster -1 conflicts with nothing.

    Pieces are taken in the order given. Sizes are at most `capacity`.
    """
    room: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        lane = ((1 << per_source) - 1) << (source * per_source)
        top = 1 << (source * per_source + per_source - 1)
        own = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (size, -1))
        while at < len(room) and (source_bits[room[at][1]] & top or cluster_bits[room[at][1]] & own):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        taken = source_bits[b] & lane
        source_bits[b] |= (taken << 1 | 1 << (source * per_source)) & lane
        cluster_bits[b] |= own
        bins[k], offsets[k] = b, capacity - left
        if left > size:
            insort(room, (left - size, b))
    return bins, offsets


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def best_fit(docs: DataFrame, capacity: int = 2048, per_source: int = 4, block_rows: int = 5000, cluster: Column | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start (word), size (words, and one for the end), bin_id, bin_offset, source.

    cluster: what documents of one duplicate cluster have in common, null for a document of none; equal texts by default.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (word_count(text) + 1).cast("long").alias("words"),
        (F.when(F.length(text) > 0, F.xxhash64(text)) if cluster is None else F.when(cluster.isNotNull(), F.xxhash64(cluster))).alias("cluster"),
    )
    dealt = told_apart(slim, "copy").withColumn("block", F.pmod(F.xxhash64(*slim.columns, "copy"), F.lit(blocks)).cast("int")).drop("copy")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("words", "descending"), *((c, "ascending") for c in ("doc_id", "cluster", "source"))])
        words = rows.column("words").to_numpy()
        full, rest = words // capacity, words % capacity
        count = full + (rest > 0)
        row = np.repeat(np.arange(len(words)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        size = np.where(piece < full[row], capacity, rest[row])
        order = np.lexsort((row, -size))
        row, piece, size = row[order], piece[order], size[order]
        number = lambda c: rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        source, group = number("source"), number("cluster")
        several = np.bincount(group + 1, minlength=1) > 1
        several[0] = False
        small = np.where(several, np.cumsum(several) - 1, -1)[group + 1]
        bins, offsets = pack(size, source[row], small[row], capacity, per_source)
        of = pa.array(row)
        return pa.table({
            "doc_id": rows.column("doc_id").take(of), "piece": pa.array(piece, pa.int32()), "start": piece * capacity, "size": pa.array(size, pa.int32()),
            "bin_id": (key[0].as_py() << 32) + bins, "bin_offset": pa.array(offsets, pa.int32()), "source": rows.column("source").take(of),
        })

    return dealt.groupBy("block").applyInArrow(run, SCHEMA)
