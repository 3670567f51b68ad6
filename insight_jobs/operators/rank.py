"""Cut-offs and image choice after retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words and limits of the image rules.
PERSON_THRESHOLD_WORDS = ["author", "wrote", "reviewer", "who is", "person", "photo"]
PERSON_WORDS = ["author", "who is", "reviewer", "wrote", "editor"]
WIDE_WORDS = ["author", "wrote", "reviewer", "editor", "who is", "about"]
PORTRAIT_WORDS = ["headshot", "portrait", "photo", "person", "author", "reviewer", "man", "woman", "face"]
CAPTION_WORDS = ["author", "reviewer", "who is", "wrote"]
NOT_PORTRAIT = ["figure", "table", "diagram", "topics", "chapter", "contents"]
THRESHOLD, PERSON_THRESHOLD, MISMATCH = 0.40, 0.25, 0.3
# End of the fixed values.


def has(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def precision_cutoff(scored: DataFrame, top_n: int = 5) -> DataFrame:
    """The five best by score; of more than three, those under the value at a third of the ascending order go."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= top_n)
    all_of = Window.partitionBy("question_id")
    values = F.sort_array(F.collect_list("score").over(all_of))
    cut = F.when(F.size(values) > 3, F.get(values, F.floor(F.size(values) / 3).cast("int")))
    return ranked.withColumn("cut", cut).where("cut IS NULL OR score >= cut").drop("cut")


def candidate_images(questions: DataFrame, hits: DataFrame, images: DataFrame, most: int = 5) -> DataFrame:
    """question_id, doc_id, page, img_idx, place: images near the hits' pages, the first five in page order, nearest first.

    Page windows are spread into rows, so that images meet them by equality. images: doc_id, page, img_idx, caption.
    """
    text = F.col("text")
    q = questions.select("question_id", (has(text, WIDE_WORDS) & (F.col("query_class") == "FACTOID")).alias("wide"), has(text, CAPTION_WORDS).alias("portrait"))
    last = images.groupBy("doc_id").agg(F.max("page").alias("last"))
    pages = hits.select("question_id", "doc_id", "page").distinct().join(q, "question_id").join(last, "doc_id", "left")
    reach = F.when(F.col("wide"), 8).otherwise(2)
    near = F.sequence(F.col("page") - reach, F.col("page") + reach)
    ends = F.concat(F.sequence(F.lit(1), F.lit(20)), F.sequence(F.greatest(F.lit(1), F.col("last") - 10), F.greatest(F.lit(1), F.col("last"))))
    windows = pages.select("question_id", "doc_id", "portrait", F.explode(F.when(F.col("wide"), F.concat(near, ends)).otherwise(near)).alias("page")).distinct()
    lowest = hits.groupBy("question_id").agg(F.min("page").alias("low"))
    met = windows.join(images, ["doc_id", "page"]).where(~(F.col("portrait") & has(F.coalesce("caption", F.lit("")), NOT_PORTRAIT)))
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy("page", "img_idx", "doc_id"))).where(F.col("k") <= most)
    order = Window.partitionBy("question_id").orderBy(F.abs(F.col("page") - F.col("low")), "k")
    return first.join(lowest, "question_id").select("question_id", "doc_id", "page", "img_idx", F.row_number().over(order).alias("place"))


def rank_images(scored: DataFrame, most: int = 3) -> DataFrame:
    """question_id, img_id, score, rank; scored: question_id, img_id, question, caption, description, score."""
    q, cap = F.lower("question"), F.lower(F.coalesce("caption", F.lit("")))
    other = (cap.contains("reviewer") & q.contains("author") & ~q.contains("reviewer")) | (cap.contains("author") & q.contains("reviewer") & ~q.contains("author"))
    value = F.when(other, F.col("score") * MISMATCH).otherwise(F.col("score"))
    least = F.when(has(q, PERSON_THRESHOLD_WORDS), PERSON_THRESHOLD).otherwise(THRESHOLD)
    person = ~has(q, PERSON_WORDS) | has(F.coalesce("description", F.lit("")), PORTRAIT_WORDS)
    kept = scored.select("question_id", "img_id", value.alias("score"), least.alias("least"), person.alias("person")).where("person AND score >= least")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "img_id"))).where(F.col("rank") <= most).select("question_id", "img_id", F.round("score", 2).alias("score"), "rank")


def retrieval_report(questions: DataFrame, pages: DataFrame, gated: DataFrame, logs: DataFrame) -> DataFrame:
    """question_id, query_type, query_class, pages, confidence, should_answer, warning, retrieval_log; logs: question_id, log."""
    report = questions.select("question_id", "query_type", "query_class").join(pages, "question_id", "left").join(gated.select("question_id", "confidence", "should_answer", "warning"), "question_id", "left")
    return report.join(logs.select("question_id", F.col("log").alias("retrieval_log")).distinct(), "question_id", "left")
