"""A table kept by key: hash buckets, generations of files, and a manifest that names those that count.

    <path>/data/gen=<generation>/bucket=<b>/...    files of one bucket, as Spark's bucketed writer names them
    <path>/manifest/<version>.json                 the generations of each bucket, and the last batch of each stream

A change writes new generations of the buckets that its keys fall into, then the next manifest, in one rename. Whatever
stops it before that leaves the table as it was. The files are a bucketed table to Spark, so that what is stored is
joined by key where it lies: only the change is shuffled, once. Whole rows are written as a generation right away, which
counts as it is in buckets that hold nothing yet. `append` adds rows of new keys without reading what is stored; a bucket
of many generations is rewritten as one on the way.

Keys aren't null: rows with a null key are left out of a change. Of several rows of a change with one key the first in
`order` counts. There may be one writer at a time; a second one fails at its manifest and has changed nothing. Columns may not
be named gen or bucket.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shared

GEN, BUCKET = "gen", "bucket"


class KeyedTable:
    """keys: what a row is known by; by: the first keys, which decide its bucket."""

    def __init__(self, spark: SparkSession, path: str, told: dict):
        self.spark, self.path = spark, path
        self.keys, self.by, self.buckets = told["keys"], told["by"], told["buckets"]
        self.schema = T.StructType.fromJson(told["schema"])
        self.name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
        # Joins of this session may use buckets by some of the keys. Settings of the caller's session stay as they are.
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.session.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        self.session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        self.session.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")  # a task's rows are of one bucket: no sort before they are written
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            by = ", ".join(f"`{c}`" for c in self.by)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {GEN} STRING, {BUCKET} INT) USING parquet OPTIONS (path '{path}/data', compression 'zstd') PARTITIONED BY ({GEN}, {BUCKET}) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS")
            if shared.exists(spark, f"{path}/data"):
                spark.catalog.recoverPartitions(self.name)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> KeyedTable:
        """A new, empty table; it is an error if there is one."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        told = {"version": 0, "schema": plain.jsonValue(), "keys": keys, "by": by or keys, "buckets": buckets, "current": {}, "marks": {}}
        shared.write_new(spark, f"{path}/manifest/{0:020d}.json", json.dumps(told))
        return cls(spark, path, told)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        return cls(spark, path, cls._latest(spark, path))

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> KeyedTable:
        """The table at a path, made if there is none."""
        if not shared.names_in(spark, f"{path}/manifest"):
            return cls.create(spark, path, schema, keys, by, buckets)
        return cls.open(spark, path)

    @staticmethod
    def _latest(spark: SparkSession, path: str) -> dict:
        names = [n for n in shared.names_in(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            raise FileNotFoundError(f"no table at {path}")
        return json.loads(shared.read_text(spark, f"{path}/manifest/{names[-1]}"))

    def manifest(self) -> dict:
        return self._latest(self.spark, self.path)

    def has(self, mark: tuple[str, int]) -> bool:
        """Whether the table has a stream's batch."""
        return self.manifest()["marks"].get(mark[0], -1) >= mark[1]

    def bucket(self) -> Column:
        """A row's bucket: Spark's own bucket number."""
        return F.pmod(F.hash(*self.by), F.lit(self.buckets))

    def read(self, version: dict | None = None) -> DataFrame:
        """The rows that count now (or by a manifest taken earlier)."""
        return self._rows(self.spark, version or self.manifest(), None)

    def where_it_lies(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count now (of some buckets), dealt by `by` as they are stored, in the table's own session."""
        return self._rows(self.session, self.manifest(), buckets)

    def _rows(self, session: SparkSession, told: dict, buckets: list[int] | None) -> DataFrame:
        wanted: dict[str, list[int]] = {}
        for b, gens in told["current"].items():
            for gen in gens if buckets is None or int(b) in buckets else []:
                wanted.setdefault(gen, []).append(int(b))
        chosen = F.lit(False)
        for gen, bs in sorted(wanted.items()):
            chosen = chosen | ((F.col(GEN) == gen) & F.col(BUCKET).isin(bs))
        return session.table(self.name).where(chosen).drop(GEN, BUCKET)

    def stage(self, incoming: DataFrame, order: list[str] | None = None, single: bool = False, rule: Callable[[DataFrame], DataFrame] = lambda df: df) -> str:
        """Write rows as a generation that doesn't count yet; returns its name. single: the rows are one a key already."""
        gen = uuid.uuid4().hex
        self._write(rule(self._dealt(incoming, self.keys, order, single)), gen)
        return gen

    def staged(self, gen: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a generation (in some buckets), dealt by `by`, in the table's own session."""
        rows = self.session.table(self.name).where(F.col(GEN) == gen)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(GEN, BUCKET)

    def buckets_of(self, gen: str) -> list[int]:
        return sorted(int(n.removeprefix(f"{BUCKET}=")) for n in shared.names_in(self.spark, f"{self.path}/data/{GEN}={gen}") if n.startswith(BUCKET))

    def put(self, gen: str, gone: DataFrame | None = None) -> list[int]:
        """Insert or replace the rows of a staged generation and remove those of the keys of `gone`, in one rewriting of their buckets."""
        if gone is None:
            return self._put(self.manifest(), gen, None, self._replaced)
        keys = gone.select(*self.keys).distinct().withColumn(BUCKET, self.bucket())
        more = [r[0] for r in keys.select(BUCKET).distinct().collect()]  # a row a bucket at most
        dealt = keys.drop(BUCKET).repartition(self.buckets, *self.by)
        return self._put(self.manifest(), gen, None, lambda old, new: self._replaced(old, new).join(dealt, self.keys, "left_anti"), more=more)

    def refill(self, buckets: list[int], rows: DataFrame) -> None:
        """Put `rows`, which come dealt by bucket, in place of all that the given buckets hold."""
        told, gen = self.manifest(), uuid.uuid4().hex
        self._write(rows, gen)
        there = set(self.buckets_of(gen))
        if not there <= set(buckets):
            raise ValueError("rows of other buckets")
        current = {int(b): gens for b, gens in told["current"].items()}
        self._commit(told, current | {b: [gen] if b in there else [] for b in buckets}, None)

    def upsert(self, incoming: DataFrame, order: list[str] | None = None, mark: tuple[str, int] | None = None) -> list[int]:
        """Insert or replace by key; returns the buckets that were changed. order: see the module; by default all other columns.

        mark: a stream's name and its batch; a batch that the table has already is passed over.
        """
        return self._change(incoming, order, mark, lambda old, new: self._replaced(old, new))

    def append(self, incoming: DataFrame, order: list[str] | None = None, mark: tuple[str, int] | None = None, most_generations: int = 8) -> list[int]:
        """Add rows whose keys the table lacks, without reading it; returns the buckets of many generations that were made one."""
        return self._change(incoming, order, mark, lambda old, new: self._replaced(old, new), most_generations)

    def delete(self, keys: DataFrame, on: list[str] | None = None) -> list[int]:
        """Remove the rows of the given keys; `on`: all of `by` and perhaps more of the keys."""
        on = on or self.keys
        if not set(self.by) <= set(on):
            raise ValueError("name all columns that decide the bucket")
        return self._change(keys.select(*on), [], None, lambda old, new: old.join(new, on, "left_anti"), keys=on)

    def update(self, changes: DataFrame, columns: list[str], order: list[str] | None = None) -> list[int]:
        """Set some columns of the rows of the given keys; keys that the table lacks are passed over."""

        def changed(old: DataFrame, new: DataFrame) -> DataFrame:
            met = old.join(new.select(*self.keys, F.struct(*columns).alias("_new")), self.keys, "left")
            return met.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.schema.names])

        return self._change(changes.select(*self.keys, *columns), order, None, changed)

    def add(self, differences: DataFrame, columns: list[str]) -> list[int]:
        """Add to the numbers of rows by key; new keys begin at 0, and a row whose numbers are all 0 goes."""

        def summed(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.join(new.select(*self.keys, *[F.col(c).alias(f"_{c}") for c in columns]), self.keys, "full_outer")
            values = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns]
            kept = F.lit(False)
            for c in columns:
                kept = kept | (F.col(c) != 0)
            return both.select(*self.keys, *values).where(kept)

        if set(self.keys) | set(columns) != set(self.schema.names):
            return self._change(differences.select(*self.keys, *columns), None, None, summed)
        given = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]
        changes = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])
        told = self.manifest()
        gen = self.stage(differences.select(*self.keys, *columns), rule=lambda df: df.select(*self.keys, *given).where(changes))
        return self._put(told, gen, None, summed)

    def replace(self, groups: DataFrame, rows: DataFrame) -> list[int]:
        """Put `rows` in place of all rows of the given groups, which are values of `by`."""
        marked = rows.select(*self.schema.names, F.lit(True).alias("_row"))
        empty = groups.select(*self.by).join(rows.select(*self.by).distinct(), self.by, "left_anti")
        gone = empty.select(*[F.col(f.name) if f.name in self.by else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias("_row"))

        def swapped(old: DataFrame, new: DataFrame) -> DataFrame:
            left = old.join(new.select(*self.by).distinct(), self.by, "left_anti")
            return left.unionByName(new.where("_row").drop("_row")).repartition(self.buckets, *self.by)

        return self._change(marked.unionByName(gone), ["_row"], None, swapped, keys=self.by, whole_rows=True)

    def _replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select(*self.keys, F.struct(*self.schema.names).alias("_old")).join(new.select(*self.keys, F.struct(*self.schema.names).alias("_new")), self.keys, "full_outer")
        return both.select(F.coalesce("_new", "_old").alias("r")).select("r.*")

    def _dealt(self, incoming: DataFrame, keys: list[str], order: list[str] | None, single: bool = False) -> DataFrame:
        """Rows of keys that aren't null, dealt to buckets, the first of each key (all, if they are single)."""
        present = F.lit(True)
        for k in keys:
            present = present & F.col(k).isNotNull()
        placed = incoming.where(present).repartition(self.buckets, *self.by)
        if single:
            return placed
        others = [c for c in incoming.columns if c not in keys]
        first = Window.partitionBy(*keys).orderBy(*(order or others or keys))
        return placed.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")

    def _change(self, incoming: DataFrame, order: list[str] | None, mark: tuple[str, int] | None, rule: Callable[[DataFrame, DataFrame], DataFrame], most_generations: int | None = None, keys: list[str] | None = None, whole_rows: bool = False) -> list[int]:
        told = self.manifest()
        if mark and told["marks"].get(mark[0], -1) >= mark[1]:
            return []
        if keys is None and set(incoming.columns) == set(self.schema.names):
            return self._put(told, self.stage(incoming, order), mark, rule, most_generations)
        stage = f"{self.path}/incoming/{uuid.uuid4().hex}"
        placed = self._dealt(incoming, keys or self.keys, order, whole_rows)
        placed.withColumn(BUCKET, self.bucket()).write.parquet(stage)
        try:
            new = self.session.read.schema(T.StructType([*placed.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(stage)
            touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # a row a bucket at most
            current = {int(b): gens for b, gens in told["current"].items()}
            gen = uuid.uuid4().hex
            if touched:
                mine = new.drop(BUCKET).repartition(self.buckets, *self.by)
                self._write(rule(self._rows(self.session, told, touched), mine), gen)
            there = set(self.buckets_of(gen))
            self._commit(told, current | {b: [gen] if b in there else [] for b in touched}, mark)
        finally:
            shared.delete(self.spark, stage)
        return touched

    def _put(self, told: dict, staged: str, mark: tuple[str, int] | None, rule: Callable[[DataFrame, DataFrame], DataFrame], most_generations: int | None = None, more: list[int] = ()) -> list[int]:
        """Let a staged generation count; in buckets that hold rows (append: many generations) or are in `more` by the rule."""
        touched = self.buckets_of(staged)
        current = {int(b): gens for b, gens in told["current"].items()}
        many = 1 if most_generations is None else most_generations
        whole = sorted({b for b in touched if len(current.get(b, [])) >= many} | set(more))
        gen = uuid.uuid4().hex
        if whole:
            self._write(rule(self._rows(self.session, told, whole), self.staged(staged, whole)), gen)
        there = set(self.buckets_of(gen))
        for b in touched:
            current[b] = [*current.get(b, []), staged]
        for b in whole:
            current[b] = [gen] if b in there else []
        self._commit(told, current, mark)
        for b in set(whole) & set(touched):
            shared.delete(self.spark, f"{self.path}/data/{GEN}={staged}/{BUCKET}={b}")
        return whole if most_generations is not None else sorted({*touched, *whole})

    def _write(self, rows: DataFrame, gen: str) -> None:
        """Files of one generation; rows come dealt by bucket, so that each bucket is one task's file."""
        rows.select(*self.schema.names, F.lit(gen).alias(GEN), self.bucket().alias(BUCKET)).write.insertInto(self.name)

    def _commit(self, told: dict, current: dict[int, list[str]], mark: tuple[str, int] | None) -> None:
        version = told["version"] + 1
        marks = told["marks"] | ({mark[0]: mark[1]} if mark else {})
        text = json.dumps(told | {"version": version, "current": {str(b): g for b, g in current.items() if g}, "marks": marks})
        shared.write_new(self.spark, f"{self.path}/manifest/{version:020d}.json", text)

    def vacuum(self) -> list[str]:
        """Delete the generations and manifests that no longer count; returns the generations. Nobody may be reading them."""
        told = self.manifest()
        kept = {g for gens in told["current"].values() for g in gens}
        gone = [n.removeprefix(f"{GEN}=") for n in shared.names_in(self.spark, f"{self.path}/data") if n.startswith(f"{GEN}=")]
        gone = [g for g in gone if g not in kept]
        for g in gone:
            shared.delete(self.spark, f"{self.path}/data/{GEN}={g}")
        for n in shared.names_in(self.spark, f"{self.path}/manifest")[:-1]:
            shared.delete(self.spark, f"{self.path}/manifest/{n}")
        return gone

    def drop(self) -> None:
        """Delete the table and all its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        shared.delete(self.spark, self.path)
