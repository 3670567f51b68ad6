"""Training-order materialisation of token ids.

Texts are encoded with a public byte-level tokenizer, closed by an end id and cut into sequences of `length` ids. The
sequences are numbered without a gap in an order of their own (document, text, part), however the input was partitioned. A
keyed Feistel permutation over the next power of four, walked until it falls below the number of sequences, gives each its
slot in training order: a bijection, so nothing has to be sorted or kept to know where a sequence goes. Slots are cut into
shards of `per_shard`, ranges of shards are the partitions, and a shard's file has record k at byte k * stride, so that a
reader resumes at any slot with one seek.

A null or empty text is one sequence that holds the end id alone; a very long one is many sequences. Rows with null or
equal doc_id are kept as they are; equal rows have equal records, and share out their slots among them. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, mixed, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: Numbering buckets; their offsets are broadcast, so that the bound is fixed.
BUCKETS = 16_384
#: Most partitions of the training order; a partition then holds several shards.
PARTITIONS = 100_000
#: No token of the tokenizer's pattern crosses these borders, so that pieces are encoded one by one and remembered.
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")


@cache
def encoding(path: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoded(dict):
    """Ids of pieces as bytes of uint16, kept while there are fewer than `bound`."""

    def __init__(self, path: str, bound: int = 400_000):
        super().__init__()
        self.encode, self.bound = encoding(path).encode_ordinary, bound

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        value = self[piece] = np.array(self.encode(piece), "<u2").tobytes()
        return value


def permuted(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index below `size`: a Feistel network on the least even number of bits, walked into range."""
    half = max(1, -(-max(1, int(size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [mixed(np.array([key * 131 + r], np.uint64))[0] for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(size))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(size)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, tokenizer: str) -> DataFrame:
    """doc_id, text_key, part, n_ids, record (n_ids little-endian uint16, then end ids up to `length` of them)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("part", pa.int32()), ("n_ids", pa.int32()), ("record", pa.binary())])

    def begin():
        pieces = Encoded(tokenizer)
        pad = np.full(length, END, "<u2").tobytes()

        def work(batch: pa.RecordBatch) -> dict:
            rows, parts, counts, records = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                body = b"".join(map(pieces.__getitem__, PIECES.findall(text or ""))) + pad[:2]
                cut = [body[at : at + 2 * length] for at in range(0, len(body), 2 * length)]
                rows += [row] * len(cut)
                parts += range(len(cut))
                counts += [len(r) // 2 for r in cut]
                cut[-1] += pad[len(cut[-1]) :]
                records += cut
            of = pa.array(rows, pa.int64())
            return {"doc_id": batch.column("doc_id").take(of), "text_key": batch.column("text_key").take(of), "part": parts, "n_ids": counts, "record": records}

        return work

    text = F.col("text").cast("string")
    return in_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")), schema, begin, 500)


def numbered_sequences(docs: DataFrame, length: int, tokenizer: str) -> tuple[DataFrame, int]:
    """The sequences with `number`, their place in the order of (bucket, doc_id, text_key, part), and how many there are.

    The bucket is a hash of the three. Sequences are written in this order, each bucket in one file, so that a number is
    the bucket's offset and a difference of places in the file: it depends on the rows alone, not on where they lay.
    """
    order = ["doc_id", "text_key", "part"]
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int").alias("bucket")
    table = staged(sequences(docs, length, tokenizer).select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", *order))
    placed = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = placed.groupBy("bucket", "file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    before = Window.orderBy("bucket", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.select("bucket", "file", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift")))
    size = offsets.agg(F.sum("n")).first()[0] or 0
    numbered = placed.join(F.broadcast(offsets.select("bucket", "file", "shift")), ["bucket", "file"])  # a row a bucket
    return numbered.select("doc_id", "part", "n_ids", "record", (F.col("at") + F.col("shift")).alias("number")), size


def stride_of(length: int) -> int:
    """Bytes of a record in a shard's file: its ids and a line end."""
    return 2 * length + 1


def training_order(docs: DataFrame, key: int = 20, length: int = 512, per_shard: int = 8192, tokenizer: str = TOKENIZER) -> DataFrame:
    """slot, shard, byte_offset, doc_id, part, n_ids, record; each partition holds a range of shards in the order of slots."""
    table, size = numbered_sequences(docs, length, tokenizer)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size, key))

    slotted = table.withColumn("slot", slot_of("number")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    shards = max(1, -(-size // per_shard))
    ranges = min(shards, PARTITIONS)
    dealt = slotted.repartitionById(ranges, F.floor(F.col("shard").cast("long") * ranges / shards).cast("int")).sortWithinPartitions("shard", "slot")
    return dealt.select("slot", "shard", (F.pmod("slot", F.lit(per_shard)) * stride_of(length)).alias("byte_offset"), "doc_id", "part", "n_ids", "record")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write the records of `training_order` as bytes: a folder for each shard with one file, a record every stride.

    Spark's text writer puts the bytes as they are and a line end behind each record, commits whole files, and
    reaches any store that Spark does; a task that is lost is written again.
    """
    rows = ordered.select("shard", F.col("record").cast("string").alias("value"))
    rows.write.partitionBy("shard").mode("errorifexists").text(path)


def read_from(spark: SparkSession, path: str, slot: int, length: int = 512, per_shard: int = 8192) -> DataFrame:
    """slot and record from a slot on; earlier shards aren't opened. Each shard's file is one row until it is cut."""
    stride = stride_of(length)
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= slot // per_shard)
    cut = files.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / stride) - 1)).alias("k"))
    records = cut.select((F.col("shard").cast("long") * per_shard + F.col("k")).alias("slot"), F.substring("content", F.col("k").cast("int") * stride + 1, F.lit(2 * length)).alias("record"))
    return records.where(F.col("slot") >= slot)


def record_at(file, slot: int, length: int = 512, per_shard: int = 8192) -> bytes:
    """The record of a slot from its shard's open file: one seek, one read."""
    file.seek(slot % per_shard * stride_of(length))
    return file.read(2 * length)


def ids_of(record: bytes, n_ids: int) -> np.ndarray:
    return np.frombuffer(record, "<u2", n_ids)
