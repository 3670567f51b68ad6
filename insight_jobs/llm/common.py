"""Small shared helpers: shared-folder stages, Arrow batches, word splitting, gapless numbering, training samples."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a single machine whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Attribute of a staged table that holds its folder.
_FOLDER = "_stage_folder"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: lineage is cut, lost executors lose nothing.

    Its shuffle files go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _FOLDER, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables of which nothing is read any more: all that was built on them is itself staged."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(df, _FOLDER))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(rows: DataFrame, schema: pa.Schema, begin: Callable[[], Callable[[pa.RecordBatch], dict]], most: int = 2000) -> DataFrame:
    """Apply a function to Arrow batches of at most `most` rows; keys pass as Arrow arrays, so that no long becomes a double.

    begin: called once a task; gives the function from a batch to its output columns (lists or Arrow arrays).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                got = work(whole.slice(start, most))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := got[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, from_arrow_schema(schema))


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, pa.DataType]:
    """doc_id and text alone, and the Arrow type of doc_id: text stays text, anything else becomes a long."""
    textual = dict(docs.dtypes)["doc_id"] == "string"
    return docs.select(F.col("doc_id").cast("string" if textual else "long"), F.col("text").cast("string")), pa.string() if textual else pa.int64()


def told_apart(rows: DataFrame, name: str, run: int = 65_536) -> DataFrame:
    """The rows with `name`: a number from 0 among equal rows, whatever the partitioning.

    Equal rows meet as counts alone, and come back in runs of bounded length, so that any number of them may be equal.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / run))))
    last = F.least(F.col("_copies"), (F.col("_run") + 1) * run) - 1
    return runs.select(*rows.columns, F.explode(F.sequence(F.col("_run") * run, last)).alias(name))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and the characters 9 to 13, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept while there are fewer than `bound`."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a word-hash sequence; a shorter sequence is one shingle, an empty one none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    width_here = min(width, len(hashes))
    out = np.full(len(hashes) - width_here + 1, width_here, np.uint64)
    for k in range(width_here):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width_here + 1 + k])
    out.sort()
    fresh = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """Add `name`: a gapless number from 0 within each group `by` (few groups, any size).

    Rows are counted by (group, hash bucket); running sums of these bounded counts give each bucket its offset, and
    only the rows of one bucket are ranked together. The numbering depends on `order` values alone; rows equal in
    all of them share a bucket and are ranked in any order, so that `order` should tell repeated rows apart.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    with_bucket = df.withColumn("_bucket", bucket)
    group = [*by, "_bucket"]
    counts = with_bucket.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group).orderBy(*order)
    ranked = with_bucket.withColumn("_rank", F.row_number().over(inside) - 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c != "_bucket" else F.col("a._bucket") == F.col("b._bucket") for c in group]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    joined = ranked.alias("a").join(offsets.alias("b"), condition)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._offset") + F.col("a._rank")).cast("long").alias(name))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, bound: int) -> DataFrame:
    """text and y (the label) of at most `bound` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    Only labels that have a document here are chosen from, so that a part of the corpus still gives a whole sample.
    The chosen ids are a table of at most `bound` rows, so that broadcasting them is safe; texts come whole. An id that
    has several labels has the smallest of them; of an id with several texts all count, in the order of their hashes.
    The rows are one partition, in that order.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder != left_out))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(bound).select("text", "y")


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """What `fit` makes of the (text, label) rows of a bounded sample, in a task: texts and working memory stay off the driver.

    A text that comes again, exactly or nearly, is left out, so that large groups of copies don't outvote the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t or "", int(y > 0)) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(without_copies(rows)))], pa.binary())], names=["model"])

    made = sample.mapInArrow(run, "model binary").collect()  # a model of a bounded sample
    return pickle.loads(made[0]["model"]) if made else fit([])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, bound: int) -> list[tuple[str, int]]:
    """The (text, label) rows that a fit is given."""
    return fitted(labelled_rows(docs, labels, label, fold, left_out, bound), lambda rows: rows)


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows but those that share one of four minimal shingles with an earlier row."""
    seen: set[tuple[int, int]] = set()
    hashes = WordHashes()
    out = []
    for text, y in rows:
        shingles = shingle_set(hashes.of(words_of(text.lower())), 5)
        if len(shingles):
            marks = {(k, int(mixed(shingles ^ np.uint64(k * 0x51ED27)).min())) for k in range(4)}
            if marks & seen:
                continue
            seen |= marks
        out.append((text, y))
    return out


