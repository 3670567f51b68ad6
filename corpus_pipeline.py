"""From raw documents to packed bins: toxicity, quality, near duplicates, packing.

Each stage gets what the one before kept; all but the last return the columns of documents.

Verdicts go by row, not by doc_id: a row without doc_id, or one that repeats another, is judged like any other. Null and empty
texts aren't toxic, have the quality score of a text without words, and are nobody's near duplicate; of rows with equal texts
one stays, the smallest doc_id first. Very long texts go through whole. An empty table gives an empty result.
Columns beside doc_id, text and source pass through all stages but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight_jobs.llm import neardup, packing, quality, toxicity
from insight_jobs.llm.common import dropped, staged


def _free_name(docs: DataFrame) -> str:
    """A column's name that the documents don't have, nor with an ending."""
    name = "_row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def _placed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of each row's own, and its name: the file's digest and the place in the file.

    Documents that aren't read straight from files are written first.
    """
    key = _free_name(docs)
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.concat_ws("#", F.md5(at["file_path"]), at["row_index"]).alias(key)), key
    except AnalysisException:
        return _placed_rows(staged(docs))


def _numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written once with a number of each row's own, and its name. `run` deletes them later."""
    key = _free_name(docs)
    return staged(docs.withColumn(key, F.monotonically_increasing_id())), key


def _by_row(rows: DataFrame, key: str) -> DataFrame:
    """Key and text, the key in place of doc_id, for operators that give doc_id back."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def _keeping(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows whose key is the doc_id of a row of `kept`, without the key."""
    return rows.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi").drop(key)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _placed_rows(docs)
    scored = toxicity.score_documents(_by_row(rows, key), toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _keeping(rows, key, scored.where(F.col("score") < toxicity.CUT))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _placed_rows(docs)
    scored = quality.score_documents(_by_row(rows, key), quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _keeping(rows, key, scored.where(F.col("score") >= quality.CUT))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component; one without doc_id only where no row has any."""
    rows, key = _numbered_rows(docs)
    grouped = neardup.near_duplicates(_by_row(rows, key)).select(F.col("doc_id").alias(key), F.col("component_id").alias(f"{key}_of"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    first = rows.select(key, "doc_id").join(grouped, key).groupBy(f"{key}_of").agg(F.min_by(key, order).alias("doc_id"))
    out = _keeping(rows, key, first)
    out._written_rows = rows
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [("toxicity", without_toxic), ("quality", good_only), ("near_duplicates", one_of_each), ("packing", packed)]

#: The classifiers are fitted on a sample and the edges found by hashing: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, kept = docs, stage(spark, docs, sf_dir)
        docs = staged(kept)
        dropped(*[t for t in (getattr(kept, "_written_rows", None), before if k else None) if t is not None])
    return STAGES[-1][1](spark, docs, sf_dir)
