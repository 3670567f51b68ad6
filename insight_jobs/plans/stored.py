"""Queries of what is stored and kept up to date: keyed tables, streams, the keyword index, cells, CSV read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, dense, keyword_index
from ..sources import io, shared
from ..sources.keyed import KeyedTable
from ..streaming import streams
from .docs import CHUNKS_SQL, COS, DOCS_SQL, Q_SQL, _bm25_cte, benchmark, docs, marked_pages, scoped, vector_questions, vectors
from .registry import query, table


def result(df: DataFrame, *made: str) -> DataFrame:
    """Write a query's rows and delete what was made for it."""
    out = shared.written(df, shared.fresh_dir(df.sparkSession, "result"))
    for path in made:
        shared.delete(df.sparkSession, path)
    return out


def csv_read_back(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = shared.fresh_dir(spark, "csv")
    read = io.read_table(spark, io.write_table(df, folder, "table", "all", uuid.uuid4().hex))
    return result(read, folder)


BLANKS = ", ".join(f"'{m}'" for m in io.MISSING)


@query(f"SELECT doc_id, CASE WHEN trim(text) NOT IN ({BLANKS}) THEN text END AS text, lang, source, n_chars FROM documents")
def table_read_back(spark, d):
    """The documents written as CSV and read again: quotes, line ends, types; blank texts come back as null."""
    return csv_read_back(spark, docs(spark, d))


@query("SELECT event_id, user_id, ts, event_type, value, props, value > 50 AS high, (event_id::HUGEINT * 1000000000000000000)::VARCHAR AS wide, strftime(ts, '%Y-%m-%d') AS day FROM events")
def events_read_back(spark, d):
    """Times, dates, booleans, doubles, long whole numbers and JSON through CSV."""
    e = table(spark, d, "events")
    wide = F.col("event_id").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)")
    read = csv_read_back(spark, e.withColumn("high", F.col("value") > 50).withColumn("wide", wide.cast("decimal(38,0)")).withColumn("day", F.to_date("ts")))
    return read.select("event_id", "user_id", "ts", "event_type", "value", "props", "high", F.col("wide").cast("decimal(38,0)").cast("string").alias("wide"), F.date_format("day", "yyyy-MM-dd").alias("day"))


ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double"


@query(
    "WITH u AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 1000000000, 'N', o_totalprice FROM orders WHERE o_orderkey % 7 = 0) "
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM u WHERE o_orderkey % 5 <> 0"
)
def keyed_changes(spark, d):
    """Orders kept by key: inserted and replaced, deleted, updated."""
    path = shared.fresh_dir(spark, "keyed")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = KeyedTable.create(spark, path, ORDERS, ["o_orderkey"], buckets=16)
    kept.append(orders)
    changed = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = orders.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    kept.upsert(changed.union(new))
    kept.delete(kept.read().where("o_orderkey % 5 = 0").select("o_orderkey"))
    kept.update(kept.read().where("o_orderkey % 11 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), ["o_totalprice"])
    out = result(kept.read())
    kept.drop()
    return out


def stored_nodes(documents: DataFrame) -> DataFrame:
    return chunks.hierarchical_chunks(marked_pages(documents)).select("doc_id", F.col("chunk_id").alias("node_id"), "text")


@query(f"SELECT doc_id, chunk_id AS node_id, substr(text, 1, 2000) AS text FROM {CHUNKS_SQL} WHERE trim(text) <> ''")
def stream_ingest(spark, d):
    """All documents through the ingest stream, twice; the second run finds nothing new."""
    path, source = shared.fresh_dir(spark, "ingest"), docs(spark, d)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    for run in range(2):
        streams.stream_ingest(spark, f"{d}/documents.parquet", ddl, f"{path}/nodes", f"{path}/check{run}", stored_nodes, ["doc_id", "node_id"], f"run{run}", 16, "text").awaitTermination()
    sink = KeyedTable.open(spark, f"{path}/nodes")
    out = result(sink.read())
    sink.drop()
    shared.delete(spark, path)
    return out


@query("SELECT user_id AS session_id, count(*) AS turns, max(ts) AS updated_at FROM events GROUP BY 1")
def stream_turns(spark, d):
    """Events as turns of their users, through the counting stream."""
    path, source = shared.fresh_dir(spark, "turns"), table(spark, d, "events")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    streams.stream_turns(spark, f"{d}/events.parquet", ddl, f"{path}/sessions", f"{path}/check", session="user_id", at="ts").awaitTermination()
    sink = KeyedTable.open(spark, f"{path}/sessions")
    out = result(sink.read())
    sink.drop()
    shared.delete(spark, path)
    return out


def updated_index(spark, d) -> keyword_index.KeywordIndex:
    """An index of stale and superfluous chunks, brought up to the documents by changes."""
    base = scoped(spark, d)
    stale = base.withColumn("text", F.when(F.col("chunk_id") % 10 == 0, F.concat(F.lit("stale words "), F.reverse("text"))).otherwise(F.col("text")))
    extra = base.where("chunk_id % 9 = 0").withColumn("chunk_id", -1 - F.col("chunk_id"))
    index = keyword_index.KeywordIndex.build(stale.union(extra), shared.fresh_dir(spark, "index"), blocks=256, buckets=64)
    index.change(base.where("chunk_id % 10 = 0"), extra.select("scope", "chunk_id"))
    return index


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)}, rk AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM bm WHERE score > 0) SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 10")
def keyword_topk(spark, d):
    """The same rows as bm25_topk, from a stored index after changes, by block bounds."""
    index = updated_index(spark, d)
    hits = index.topk(benchmark(spark, d), 10).select("question_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
    return result(hits, index.path)


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)} SELECT scope, term, df, round(idf, 6) AS idf FROM te")
def keyword_terms(spark, d):
    """The same statistics as bm25_index, from a stored index after changes."""
    index = updated_index(spark, d)
    return result(index.statistics()[0].withColumn("idf", F.round("idf", 6)), index.path)


@query(f"SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a JOIN documents p ON p.doc_id = a.vec_id JOIN documents q ON q.lang = p.lang JOIN embeddings b ON b.vec_id = q.doc_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 10")
def dense_topk_scoped(spark, d):
    """Each question among the vectors of its document's language."""
    lang = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"))
    base = vectors(spark, d).join(lang, F.col("chunk_id") == F.col("id")).drop("id")
    asked = vector_questions(spark, d).join(lang, F.col("question_id") == F.col("id")).drop("id")
    return dense.dense_topk(asked, base, 10, "scope").select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def dense_topk_cells(spark, d):
    """By a stored inverted file, approximately."""
    path = shared.fresh_dir(spark, "cells")
    dense.build_cells(vectors(spark, d), path)
    return result(dense.dense_topk_cells(spark, vector_questions(spark, d), path, 10), path)


def bm25_rows_read(spark: SparkSession, d: str) -> DataFrame:
    """What the bounds spare: question_id, postings, postings_read."""
    index = keyword_index.KeywordIndex.build(scoped(spark, d), shared.fresh_dir(spark, "index"), blocks=256, buckets=16)
    return result(index.search_report(benchmark(spark, d), 10), index.path)

