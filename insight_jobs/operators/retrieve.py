"""Retrieval for a table of questions: keyword and dense lanes, fusion, adaptive depth, contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from .chunks import cosine
from .dense import best_in_units, dense_topk, of_one_length

# Fixed values of the ranking formulas.
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
ENOUGH = 0.50
# End of the fixed values.

#: Words of questions that are sent to every task; beyond, they are joined. Parts that chunks are dealt into, at least, and chunks of a part.
SENT_WORDS, CHUNK_PARTS, PART_CHUNKS = 500_000, 256, 2000
#: Hits that are sent to the texts; beyond, they are joined.
SENT_HITS = 100_000


def lane_rows(hits: DataFrame, lane: int) -> DataFrame:
    """A lane's rows for a union of lanes.

    The key goes through an expression, so that the union doesn't promise its inputs' partitioning: Spark 4.1 zips such
    inputs by partition, and that fails once adaptive execution has coalesced one of them.
    """
    key = F.when(F.col("rank") > 0, F.col("question_id"))
    return hits.select(key.alias("question_id"), "chunk_id", "rank", F.lit(lane).alias("lane"))


def top(df: DataFrame, k: int, order: list, by: list[str] = ("question_id",)) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def tokens(text: Column, lower: bool = True) -> Column:
    return F.filter(F.split(F.lower(text) if lower else text, r"\s+"), lambda w: w != "")


def word_counts(chunks: DataFrame, lower: bool = True) -> DataFrame:
    """scope, term, df, words.

    One pass: each chunk gives its distinct words and one null term that carries its length, and both are counted
    before they are shuffled.
    """
    ws = tokens(F.col("text"), lower)
    every = chunks.select("scope", ws.alias("ws")).select("scope", F.size("ws").alias("dl"), F.explode(F.concat(F.array_distinct("ws"), F.array(F.lit(None).cast("string")))).alias("term"))
    return every.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words"))


def parted(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts as words (scope, term, df) and scopes (scope, n, avgdl)."""
    return counted.where("term IS NOT NULL").select("scope", "term", "df"), counted.where("term IS NULL").select("scope", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))


def raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def floored(raw: Column) -> Column:
    return F.when(raw < 0, EPSILON * F.col("mean")).otherwise(raw).alias("idf")


def bm25_statistics(chunks: DataFrame, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """terms (scope, term, df, idf), scopes (scope, n, avgdl). A negative idf becomes epsilon times the scope's mean idf."""
    df, scopes = parted(word_counts(chunks, lower))
    raw = df.join(scopes.select("scope", "n"), "scope").withColumn("raw", raw_idf())
    mean = raw.groupBy("scope").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "scope").select("scope", "term", "df", floored(F.col("raw"))), scopes


def weighted_words(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """asked (scope, term, ...) with idf, n and avgdl, of written word counts; words that no chunk has are dropped.

    A scope's mean is taken over the counts that occur, each with the number of its words, so that the words of a scope don't meet.
    """
    df, scopes = parted(counted)
    mean = df.groupBy("scope", "df").agg(F.count(F.lit(1)).alias("like")).join(scopes, "scope").groupBy("scope").agg((F.sum(F.col("like") * raw_idf()) / F.sum("like")).alias("mean"))
    return asked.join(df, ["scope", "term"]).join(scopes.join(mean, "scope"), "scope").select(*asked.columns, floored(raw_idf()), "n", "avgdl")


def bm25_postings(chunks: DataFrame, lower: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """scope, chunk_id, term, tf, dl; asked (scope, term): words that are looked for, once each; others go before they are counted."""
    words = chunks.select("scope", "chunk_id", tokens(F.col("text"), lower).alias("ws")).select("scope", "chunk_id", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    found = words if asked is None else words.join(asked, ["scope", "term"], "left_semi")
    return found.groupBy("scope", "chunk_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(chunks: DataFrame, lower: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (scope, chunk_id, term, tf, dl), terms (scope, term, df, idf), scopes (scope, n, avgdl) of chunks (scope, chunk_id, text)."""
    return bm25_postings(chunks, lower), *bm25_statistics(chunks, lower)


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int, lower: bool = True, keep_zero: bool = False) -> DataFrame:
    """question_id, scope, chunk_id, score, rank; questions: question_id, scope, text. Repeated query words count again.

    Chunks are dealt by their key before their words are taken apart; counting, weighing and adding up then stay where a chunk
    is, so that no word's postings meet in one task. Words that no question has are dropped first.
    """
    asked = questions.select("question_id", "scope", F.explode(tokens(F.col("text"), lower)).alias("term")).groupBy("question_id", "scope", "term").agg(F.count(F.lit(1)).alias("times"))
    spark = questions.sparkSession
    place = shared.fresh_dir(spark, "counted")
    counted = shared.written(word_counts(chunks, lower), place)  # a row a word: texts are read for it once
    weighted = shared.written(weighted_words(asked, counted), shared.fresh_dir(spark, "weighted"))  # the words of the questions
    sent = F.broadcast if weighted.count() <= SENT_WORDS else lambda df: df  # SENT_WORDS rows at most; beyond, they are joined
    n = parted(counted)[1].agg(F.sum("n")).first()[0] or 0
    shared.delete(spark, place)
    parts = max(CHUNK_PARTS, -(-n // PART_CHUNKS))  # so that a task's chunks don't grow in number with the table
    dealt = chunks.select("scope", "chunk_id", "text").repartition(parts, "chunk_id")
    hit = bm25_postings(dealt, lower, sent(weighted.select("scope", "term").distinct())).join(sent(weighted), ["scope", "term"])
    tf = F.col("tf")
    score = F.sum(F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    scored = hit.groupBy("question_id", "scope", "chunk_id").agg(score.alias("score"))
    return top(scored if keep_zero else scored.where("score > 0"), k, [F.desc(F.round("score", 9)), "chunk_id"])


def dense_topk_lsh(questions: DataFrame, vectors: DataFrame, k: int, bucket: float = 0.5, tables: int = 8, reach: float = 1.2) -> DataFrame:
    """An approximate form for large corpora: random projections of unit vectors, exact distances in shared buckets.

    A bucket is a unit of dense search, which large ones are dealt from into parts; k rows a question leave each, and no pairs.
    A question with k hits within `reach` has its neighbours there; one with fewer is answered by `dense_topk`.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    some, plain = of_one_length(vectors, questions)
    prepare = lambda df: Normalizer(inputCol="v", outputCol="features").transform(df.withColumn("v", array_to_vector("embedding")))
    base, asked = prepare(some.select("chunk_id", "embedding")), prepare(plain.select("question_id", "embedding"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(base)
    buckets = F.posexplode(F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)))).alias("table", "bucket")
    dealt = lambda df, key: model.transform(df).select(key, "embedding", buckets).select(F.concat_ws("#", "table", "bucket").alias("scope"), key, "embedding")
    near = best_in_units(dealt(base, "chunk_id"), dealt(asked, "question_id"), k).where(F.col("score") > 1 - reach**2 / 2)
    scored = near.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))  # a pair may share several buckets
    found = shared.written(top(scored, k, [F.desc("score"), "chunk_id"]), shared.fresh_dir(questions.sparkSession, "near"))  # k rows a question
    full = found.where(F.col("rank") == k).select("question_id")
    exact = dense_topk(questions.join(full, "question_id", "left_anti"), vectors, k)
    # The key goes through an expression for the reason that lane_rows gives.
    plain = lambda df: df.select(F.when(F.col("rank") > 0, F.col("question_id")).alias("question_id"), "chunk_id", "score", "rank")
    return plain(found.join(full, "question_id", "left_semi")).unionByName(plain(exact))


def rrf_merge(lanes: list[DataFrame], top_n: int, k: int = RRF) -> DataFrame:
    """question_id, chunk_id, score, rank by the sum of 1 / (k + rank); an earlier lane wins ties."""
    rows = reduce(DataFrame.unionByName, [lane_rows(hits, i) for i, hits in enumerate(lanes)])
    merged = rows.groupBy("question_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    return top(merged, top_n, [F.desc(F.round("score", 12)), "first", "chunk_id"]).select("question_id", "chunk_id", "score", "rank")


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """hits with the columns of their chunks in texts (chunk_id, text, ...); texts that no hit has aren't shuffled."""
    found = shared.written(hits, shared.fresh_dir(hits.sparkSession, "hits"))  # some rows a question
    sent = F.broadcast if found.count() <= SENT_HITS else lambda df: df  # SENT_HITS rows at most; beyond, they are joined
    return sent(found).join(texts, "chunk_id")


def dedup_prefix(hits: DataFrame, n: int = 80, by: str = "question_id", order: str = "rank") -> DataFrame:
    """The first hit of each text prefix, within a question."""
    key = F.lower(F.trim(F.substring("text", 1, n)))
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).where("_k = 1").drop("_k")


def multi_query(hits: DataFrame) -> DataFrame:
    """Hits of sub-questions (question_id, sub_idx, rank, text) in order, prefix repeats removed; pos from 1."""
    ordered = hits.withColumn("_order", F.struct("sub_idx", "rank"))
    kept = dedup_prefix(ordered, order="_order")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy("_order"))).drop("_order")


def adaptive_retrieve(questions: DataFrame, dense: DataFrame, keyword: DataFrame, texts: DataFrame) -> DataFrame:
    """question_id, chunk_id, pos, confidence, round, log of the depth that each question ends at.

    questions: question_id, text, query_type, initial_k, expand_k, max_k. The lanes are ranked once to the largest
    depth; a smaller depth is a prefix of them, so the three rounds are three conditional fusions, not a loop.
    """
    from .ground import confidence

    lanes = lane_rows(dense, 0).unionByName(lane_rows(keyword, 1))
    depths = questions.select("question_id", F.posexplode(F.array("initial_k", "expand_k", "max_k")).alias("round", "k"))
    fused = lanes.join(depths, "question_id").where(F.col("rank") <= F.col("k")).groupBy("question_id", "round", "k", "chunk_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), F.min(F.struct("lane", "rank")).alias("first"))
    order = Window.partitionBy("question_id", "round").orderBy(F.desc(F.round("score", 12)), "first", "chunk_id")
    merged = with_texts(fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")), texts)
    single = dedup_prefix(merged.withColumn("qr", F.struct("question_id", "round")), by="qr").drop("qr")
    place = Window.partitionBy("question_id", "round").orderBy("rank")
    placed = single.withColumn("pos", F.row_number().over(place)).select("question_id", "round", "chunk_id", "pos", "text")
    placed = shared.written(placed, shared.fresh_dir(questions.sparkSession, "placed"))  # the hits of three rounds
    best = dense.where("rank <= 3").groupBy("question_id").agg(F.avg("score").alias("dense_score"))
    both = F.struct("question_id", "round").alias("question_id")  # each round is a question of its own
    asked = depths.join(questions.select("question_id", "text"), "question_id").select(both, "text")
    judged = placed.join(best, "question_id").select(both, F.col("pos").alias("rank"), F.col("dense_score").alias("score"), "text")
    scores = confidence(asked, judged).select("question_id.question_id", "question_id.round", "confidence")
    wide = scores.groupBy("question_id").agg(*[F.max(F.when(F.col("round") == r, F.col("confidence"))).alias(f"c{r}") for r in range(3)])
    deep = F.col("query_type").isin("analytical", "summary")
    chosen = questions.join(wide, "question_id").select("question_id", F.when(~deep & (F.col("c0") >= ENOUGH), 0).when(deep & (F.col("c1") < ENOUGH), 2).otherwise(1).alias("round"), "c0", "c1", "c2", "query_type", "initial_k", "expand_k", "max_k")
    score = F.when(F.col("round") == 0, F.col("c0")).when(F.col("round") == 1, F.col("c1")).otherwise(F.col("c2"))
    tried = lambda r, k, c: F.format_string(f"round{r}_k=%d conf=%.3f", k, c)
    first = F.format_string("type=%s budget=(%d,%d,%d)", "query_type", "initial_k", "expand_k", "max_k")
    more = F.when(F.col("round") == 0, "no_expansion").otherwise(tried(2, "expand_k", "c1"))
    log = F.concat_ws(" | ", first, tried(1, "initial_k", "c0"), more, F.when(F.col("round") == 2, tried(3, "max_k", "c2")))
    return placed.join(chosen.select("question_id", "round", score.alias("confidence"), log.alias("log")), ["question_id", "round"]).select("question_id", "chunk_id", "pos", "confidence", "round", "log")


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace children by their parents' text, once for each question and parent, at the first child's place.

    hits: question_id, doc_id, chunk_id, parent_id, pos, score, text. Without a parent the child stays.
    """
    joined = hits.join(parents.select("doc_id", "parent_id", F.col("text").alias("parent_text")), ["doc_id", "parent_id"], "left")
    key = F.coalesce(F.when(F.col("parent_text").isNotNull(), F.concat(F.lit("p"), F.col("parent_id"))), F.concat(F.lit("c"), F.col("chunk_id")))
    first = joined.withColumn("_k", F.row_number().over(Window.partitionBy("question_id", "doc_id", key).orderBy("pos"))).where("_k = 1")
    return first.select("question_id", "doc_id", "chunk_id", "parent_id", "pos", "score", F.coalesce("parent_text", "text").alias("text"))


def split_by_source(hits: DataFrame) -> DataFrame:
    """question_id, counts of text, table and image hits, and the pages of all."""
    kind = lambda k: F.count_if(F.col("source_type") == k)
    return hits.groupBy("question_id").agg(kind("text").alias("n_text"), kind("table").alias("n_table"), kind("image").alias("n_image"), F.array_sort(F.collect_set("page")).alias("pages"))


def block_text(kind: Column) -> Column:
    page = F.col("page").cast("string")
    head = F.when(F.coalesce(F.col("section_heading"), F.lit("")) != "", F.concat(F.lit("[Page "), page, F.lit(" | "), F.col("section_heading"), F.lit("]"))).otherwise(F.concat(F.lit("[Page "), page, F.lit("]")))
    return F.when(kind == "table", F.concat(F.lit("[Table on Page "), page, F.lit("]\n"), F.col("text"))).otherwise(F.concat(head, F.lit("\n"), F.col("text")))


def build_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, context: texts in order, then tables, divided by rules."""
    rows = hits.where(F.col("source_type").isin("text", "table")).select("question_id", F.struct((F.col("source_type") == "table").cast("int").alias("t"), F.col("pos").alias("p"), block_text(F.col("source_type")).alias("b")).alias("r"))
    built = rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["b"]), "\n\n---\n\n").alias("context"))
    return questions.select("question_id").join(built, "question_id", "left").select("question_id", F.coalesce("context", F.lit("No context found.")).alias("context"))


def build_subquery_context(hits: DataFrame, subs: DataFrame, most: int = 3) -> DataFrame:
    """question_id, context: merged hits dealt evenly to sub-questions, the first three of each under its text."""
    counts = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = subs.groupBy("question_id").agg(F.count(F.lit(1)).alias("m")).join(counts, "question_id").withColumn("each", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("m"))))
    dealt = hits.join(sizes, "question_id").withColumn("sub_idx", F.floor((F.col("pos") - 1) / F.col("each")).cast("int"))
    first = dealt.withColumn("k", F.row_number().over(Window.partitionBy("question_id", "sub_idx").orderBy("pos"))).where(F.col("k") <= most)
    texts = first.groupBy("question_id", "sub_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n\n").alias("body"))
    parts = subs.join(texts, ["question_id", "sub_idx"]).select("question_id", "sub_idx", F.concat(F.lit("### "), F.col("sub_text"), F.lit("\n"), F.col("body")).alias("part"))
    return parts.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub_idx", "part"))), lambda r: r["part"]), "\n\n---\n\n").alias("context"))


def source_pages(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def pairwise_cosine(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """The built-in form for pairs that share a key: cosine of a.embedding and b.embedding."""
    return a.alias("a").join(b.alias("b"), on).withColumn("score", cosine(F.col("a.embedding"), F.col("b.embedding")))
