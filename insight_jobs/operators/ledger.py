"""Turns, sessions, feedback and evaluation results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared


def last_turns(turns: DataFrame, keys: list[str], n: int, order: str = "id") -> DataFrame:
    """The last 2n messages of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2 * n).drop("_k")


def history_prompt(turns: DataFrame, keys: list[str], n: int = 3, cut: int = 300, order: str = "id") -> DataFrame:
    """keys, history: the last turns as lines, answers cut."""
    content = F.when((F.col("role") == "assistant") & (F.length("content") > cut), F.concat(F.substring("content", 1, cut), F.lit("…"))).otherwise(F.col("content"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), content)
    rows = last_turns(turns.where(F.col("role").isin("user", "assistant")), keys, n, order)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def append_turns(answered: DataFrame) -> DataFrame:
    """Two rows (user, assistant) for each answered question; none without a user. answered: user_id, question, answer, …"""
    other = [c for c in answered.columns if c not in ("question", "answer")]
    both = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    return answered.where("user_id IS NOT NULL").select(*other, both.alias("t")).select(*other, "t.part", "t.role", "t.content")


def list_sessions(sessions: DataFrame, history: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with their number of turns, newest first; turns are counted before the join."""
    counts = history.groupBy(key).agg(F.count(F.lit(1)).alias("turns"))
    return sessions.join(counts, key, "left").withColumn("turns", F.coalesce("turns", F.lit(0))).orderBy(F.desc("created_at"), key)


def session_history(history: DataFrame, sessions: DataFrame, since: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """Turns from a given time on (since: key, since), else from the session's start."""
    start = sessions.select(key, F.col("created_at").alias("start"))
    if since is not None:
        start = start.join(since, key, "left").select(key, F.coalesce("since", "start").alias("start"))
    return history.join(start, key).where("start IS NULL OR created_at >= start").drop("start")


def update_last_answer(history: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Set the answer on the newest row of each key; blank updates count for nothing."""
    fresh = updates.where("trim(answer) <> ''").select(*keys, F.col("answer").alias("_new"))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id"))) == 1
    return history.withColumn("_newest", newest).join(fresh, keys, "left").withColumn("answer", F.when(F.col("_newest"), F.coalesce("_new", "answer")).otherwise(F.col("answer"))).drop("_new", "_newest")


def touch_sessions(sessions: DataFrame, turns: DataFrame, key: str = "session_id") -> DataFrame:
    latest = turns.groupBy(key).agg(F.max("created_at").alias("_latest"))
    return sessions.join(latest, key, "left").withColumn("updated_at", F.greatest("updated_at", "_latest")).drop("_latest")


# The names of counts in a document's metadata, the newer one first.
COUNTS = (["text_chunks", "text_count"], ["images_found", "image_count"], ["tables_found", "table_count"])
# End of the fixed values.


def from_either(text: Column, names: list[str]) -> Column:
    """The first of several keys that a JSON text has."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def list_documents(sessions: DataFrame, user: Column | None = None) -> DataFrame:
    """A user's documents (or all users'), newest first, with the counts of their metadata under either name, 0 without."""
    rows = sessions.where(F.col("user_id") == user) if user is not None else sessions
    counts = [F.coalesce(from_either(F.col("metadata"), names).try_cast("long"), F.lit(0)).alias(names[0]) for names in COUNTS]
    return rows.select("user_id", "doc_id", "created_at", *counts).orderBy("user_id", F.desc("created_at"), "doc_id")


def feedback_valid(feedback: DataFrame) -> DataFrame:
    return feedback.where(F.col("rating").isin(1, -1))


def feedback_rollup(feedback: DataFrame, key: str) -> DataFrame:
    return feedback_valid(feedback).groupBy(key).agg(F.count_if(F.col("rating") == 1).alias("up"), F.count_if(F.col("rating") == -1).alias("down"))


def latest_eval(results: DataFrame, key: str, metrics: list[str], order: list[str]) -> DataFrame:
    """The newest result of each key with the mean of the metrics that are there."""
    newest = results.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_k = 1").drop("_k")
    there = F.filter(F.array(*[F.col(m).cast("double") for m in metrics]), lambda x: x.isNotNull())
    return newest.withColumn("overall", F.round(F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, b: a + b), F.size(there)), 4))


def eval_rollup(results: DataFrame) -> DataFrame:
    """category (null: all), passed, total, share; results: category, passed (boolean)."""
    return results.rollup("category").agg(F.count_if(F.col("passed")).alias("passed"), F.count(F.lit(1)).alias("total")).withColumn("share", F.round(F.col("passed") / F.col("total"), 4))


def run_table_checks(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """check_id, expected, passed: whether an answer's text holds the expected number."""
    from ..functions.rules import contains_number

    return answers.join(expected, "check_id").select("check_id", "expected", contains_number(F.col("text"), F.col("expected"), F.col("tolerance")).alias("passed"))


def sample_eval_chunks(chunks: DataFrame, n: int, order: list[str], parts: int = 64) -> DataFrame:
    """Of each document's chunks over 100 characters every so many, n at most, cut at 800 characters.

    Places are found among the keys alone, which are dealt into ranges of their order; only texts that are taken meet them.
    """
    spark, keys = chunks.sparkSession, ["doc_id", *order]
    rows = chunks.where(F.length("text") > 100).withColumn("text", F.substring("text", 1, 800))
    dealt = rows.select(*keys).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    dealt = shared.written(dealt, shared.fresh_dir(spark, "places"))  # keys alone; rows of one key are in one part
    sizes = dealt.groupBy("doc_id", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    of_doc = Window.partitionBy("doc_id")
    before = F.sum("_rows").over(of_doc.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("doc_id", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(of_doc).alias("_n"))  # `parts` rows a document
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    met = dealt.join(sizes.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_part", "_p"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_part") == F.col("_p")))
    placed = met.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("doc_id", "_part").orderBy(*order)) - 1)
    taken = (F.col("_k") % step == 0) & (F.floor(F.col("_k") / step) < n)
    like = Window.partitionBy(*keys).orderBy("_k")  # rows that are equal in the order are told apart by number
    wanted = placed.withColumn("_like", F.row_number().over(like)).where(taken).select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], "_like")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)])
    some = wanted.drop("_like").distinct()
    near = rows.join(some, same, "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("text")))
    return near.join(wanted, same & (F.col("_i") == F.col("_like"))).select(*chunks.columns)


def context_precision(verdicts: DataFrame) -> DataFrame:
    """question_id, context_precision: mean of precision at the relevant ranks; missing verdicts are left out."""
    w = Window.partitionBy("question_id").orderBy("rank")
    at = verdicts.where("relevant IS NOT NULL").withColumn("hits", F.sum("relevant").over(w)).withColumn("seen", F.row_number().over(w))
    return at.groupBy("question_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("relevant") == 1, F.col("hits") / F.col("seen"))), F.sum("relevant")), F.lit(0.0)), 4).alias("context_precision"))


def context_recall(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("question_id").agg(F.round(F.avg("attributed"), 4).alias("context_recall"))


def document_metadata(sessions: DataFrame, cache: DataFrame) -> DataFrame:
    """doc_id, metadata, origin: a session's record first, else the cached one."""
    first = sessions.groupBy("doc_id").agg(F.min_by("metadata", F.struct("created_at", "user_id")).alias("s"))
    out = first.join(cache.select("doc_id", F.col("metadata").alias("c")), "doc_id", "full")
    return out.select("doc_id", F.coalesce("s", "c").alias("metadata"), F.when(F.col("s").isNotNull(), "session").otherwise("cache").alias("origin"))
