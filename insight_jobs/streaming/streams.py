"""Incremental forms of document ingest and of session counters, into tables kept by key."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import shared
from ..sources.io import STORED, new_documents
from ..sources.keyed import KeyedTable


def dropped_files(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    fs, at = shared.located(spark, source)
    reader = spark.readStream.schema(schema)
    if fs.exists(at) and not fs.getFileStatus(at).isDirectory():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(source)


def passed_over(batch: DataFrame) -> None:
    """Run a batch whose rows the sink has, so that the stream's state is written too."""
    batch.write.format("noop").mode("overwrite").save()


def nodes_to_store(nodes: DataFrame, text: str = "text") -> DataFrame:
    """Nodes as they are stored: blank texts are skipped, texts cut to the stored length."""
    return nodes.where(F.trim(F.col(text)) != "").withColumn(text, F.substring(text, 1, STORED))


def stream_ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], keys: list[str], name: str = "ingest", buckets: int = 64, text: str | None = None) -> StreamingQuery:
    """Index each dropped document once: files of `source` (Parquet) -> documents not seen -> `prepare` -> nodes of the sink.

    The doc_ids seen are the stream's keyed state, so that a batch neither reads the sink nor lists its documents; only what
    the sink held before the stream first ran is left out by a join. The sink is a KeyedTable of `keys` (doc_id first) in
    buckets of doc_id; a batch adds its rows under its number, so that one that is tried again, or a stream that starts again
    from its checkpoint, adds nothing twice. Rows without doc_id are left out. text: the column to which the rules for
    stored nodes apply.
    """
    first = not shared.exists(spark, checkpoint)
    before_at = f"{checkpoint}-before.json"
    probe = prepare(spark.createDataFrame([], schema))
    KeyedTable.at(spark, sink, probe.schema, keys, ["doc_id"], buckets)
    if first and not shared.exists(spark, before_at):
        shared.write_new(spark, before_at, json.dumps(KeyedTable.open(spark, sink).manifest()))
    before = json.loads(shared.read_text(spark, before_at))

    def write(batch: DataFrame, number: int) -> None:
        table = KeyedTable.open(batch.sparkSession, sink)
        if table.has((name, number)):
            passed_over(batch)
            return
        fresh = new_documents(batch, table.read(before).select("doc_id")) if before["current"] else batch
        nodes = prepare(fresh)
        table.append(nodes_to_store(nodes, text) if text else nodes, mark=(name, number))

    documents = dropped_files(spark, source, schema).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_turns(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, name: str = "turns", buckets: int = 64, session: str = "session_id", at: str = "created_at") -> StreamingQuery:
    """Keep each session's number of turns and last time current: a batch rewrites the buckets of the sessions that changed."""
    turns = dropped_files(spark, source, schema).where(F.col(session).isNotNull())
    counted = turns.groupBy(F.col(session).alias("session_id")).agg(F.count(F.lit(1)).alias("turns"), F.max(at).alias("updated_at"))
    fields = {f.name: f.dataType for f in counted.schema}
    KeyedTable.at(spark, sink, T.StructType([T.StructField(k, fields[k]) for k in ("session_id", "turns", "updated_at")]), ["session_id"], None, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table = KeyedTable.open(batch.sparkSession, sink)
        if table.has((name, number)):
            passed_over(batch)
        else:
            table.upsert(batch, mark=(name, number))

    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sessions(spark: SparkSession, sink: str) -> DataFrame:
    """The row of each session that stream_turns keeps."""
    return KeyedTable.open(spark, sink).read()
