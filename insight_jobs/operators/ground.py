"""How well answers and retrieved texts cover questions and contexts: keyword overlap, confidence, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import ALWAYS_ANSWER, matches, plain

# Stop words, thresholds and texts that must be what they are for the same results.
QUESTION_STOP = "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought in on at to for of and or but not with this that these those what who how when where which why i you he she it we they me him her us them my your his its our their".split()
ANSWER_STOP = "a an the is are was were be been being have has had do does did will would could should may might shall can in on at to for of and or but not with this that these those it its by from as so if then than also just more some such there".split()
BLOCK, WARN = 0.35, 0.55
SUPPORTED, UNCERTAIN = 0.45, 0.15
FAITHFUL, PARTIAL = 0.55, 0.30
LEAST_WORDS = 6
ABBREVIATION = r"\b(Dr|Mr|Mrs|Ms|Prof|Fig|et al|i\.e|e\.g|vs|approx|dept)\."
FALLBACK = "I couldn't find relevant information about that in this document. Try rephrasing your question, or check if this topic is covered in the PDF."
WARNING = "The document may not fully cover this topic — this answer is based on loosely related content."
NO_WARNING = ["FACTOID", "CONVERSATIONAL", "DEFINITIONAL"]
# End of the fixed values.


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct words of three letters or more, lower case, without the stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), 0)
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def overlap(words: Column, among: Column) -> Column:
    """Share of the words found in another set; .5 without words."""
    return F.when(F.size(words) == 0, 0.5).otherwise(F.size(F.array_intersect(words, among)) / F.size(words))


def keyword_overlap(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, overlap: share of a question's content words in the texts of its first three hits."""
    top = hits.where("rank <= 3").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t")))), lambda x: x["t"]), " ").alias("found"))
    q = questions.select("question_id", content_words(F.col("text"), QUESTION_STOP).alias("words"))
    found = F.regexp_extract_all(F.coalesce("found", F.lit("")), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), 0)
    return q.join(top, "question_id", "left").select("question_id", overlap(F.col("words"), found).alias("overlap"))


def confidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, confidence, reason; hits: question_id, rank, score (dense), text."""
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    dense = hits.withColumn("k", F.row_number().over(best)).where("k <= 3").groupBy("question_id").agg(F.avg("score").alias("dense"))
    joined = questions.join(dense, "question_id", "left").join(keyword_overlap(questions, hits), "question_id")
    mixed = F.col("dense") * 0.65 + F.col("overlap") * 0.35
    value = F.when(F.col("dense").isNull(), 0.0).when(matches(plain(F.col("text")), ALWAYS_ANSWER), 1.0).otherwise(mixed)
    reason = F.when(F.col("dense").isNull(), "no_nodes").when(matches(plain(F.col("text")), ALWAYS_ANSWER), "always_answer").when(mixed < BLOCK, "low_similarity").when(mixed < WARN, "borderline").otherwise("confident")
    return joined.select("question_id", F.round(value, 3).alias("confidence"), reason.alias("reason"))


def gate(scored: DataFrame) -> DataFrame:
    """Add should_answer, warning and fallback to rows with confidence, reason and query_class."""
    free = F.col("reason") == "always_answer"
    block = ~free & (F.col("confidence") < BLOCK)
    warn = ~free & ~block & (F.col("confidence") < WARN) & ~F.col("query_class").isin(NO_WARNING)
    return scored.select("*", (~block).alias("should_answer"), F.when(warn, WARNING).alias("warning"), F.when(block, FALLBACK).alias("fallback"))


def split_sentences(text: Column) -> Column:
    """Sentences of at least six words; dots of common abbreviations end none."""
    kept = F.regexp_replace(text, ABBREVIATION, "$1\u0001")
    kept = F.regexp_replace(F.regexp_replace(kept, r"\bi\.e\u0001", "i\u0001e\u0001"), r"\be\.g\u0001", "e\u0001g\u0001")
    parts = F.split(kept, r"(?<=[.!?])\s+(?=[A-Z])")
    whole = F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", ".")))
    return F.filter(whole, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= LEAST_WORDS)


def label(score: Column) -> Column:
    return F.when(score >= SUPPORTED, "supported").when(score >= UNCERTAIN, "uncertain").otherwise("unsupported")


def sentence_support(answers: DataFrame) -> DataFrame:
    """answer_id, position, sentence, score, label; answers: answer_id, text, context.

    A context's words are taken once for each answer, then compared with each sentence.
    """
    base = answers.select("answer_id", content_words(F.col("context"), ANSWER_STOP).alias("known"), split_sentences(F.col("text")).alias("sentences"))
    rows = base.select("answer_id", "known", F.posexplode("sentences").alias("position", "sentence"))
    scored = rows.withColumn("score", overlap(content_words(F.col("sentence"), ANSWER_STOP), F.col("known")))
    return scored.select("answer_id", "position", "sentence", "score", label(F.col("score")).alias("label"))


def faithfulness(answers: DataFrame) -> DataFrame:
    """answer_id, overall_score, label and counts; answers without sentences are faithful."""
    totals = sentence_support(answers).groupBy("answer_id").agg(F.round(F.avg("score"), 3).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "supported").alias("sup"), F.count_if(F.col("label") == "unsupported").alias("uns"))
    score = F.coalesce("s", F.lit(1.0))
    word = F.when(score >= FAITHFUL, "faithful").when(score >= PARTIAL, "partial").otherwise("unfaithful")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return answers.select("answer_id").join(totals, "answer_id", "left").select("answer_id", score.alias("overall_score"), word.alias("label"), zero("sup").alias("supported_count"), zero("uns").alias("unsupported_count"), zero("n").alias("total_sentences"))
