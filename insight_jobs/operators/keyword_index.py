"""A stored keyword index: postings in blocks of documents, kept up to date by differences, searched with block bounds.

Tables under <path>, each kept by key (sources.keyed):

    chunks   block, scope, chunk_id, dl, terms   each chunk's words and their counts
    blocks   block, scope, term, docs, ...   the postings of a block of chunks, with the largest count and the least length
    terms    scope, term, df                 in how many chunks of its scope a word is
    scopes   scope, n, words                 chunks and words of a scope

A chunk's block is a hash of its key. Chunks and blocks are kept by block in like buckets, so that texts are shuffled once:
a changed chunk rewrites its own bucket, and postings are made where the bucket's chunks lie. Counts of words and scopes
change by the difference between its old and new words.

A search bounds what any chunk of a block can score by the block's largest count and least length for each word. The
blocks of the highest bounds are scored first; the k-th best score found there rules out all blocks whose bound is lower,
and their postings aren't read. The result is the same as without bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from ..sources.keyed import KeyedTable
from .retrieve import EPSILON, K1, B, tokens, top

TABLES = ("chunks", "blocks", "terms", "scopes")
POSTING = "struct<chunk_id:{kind},tf:bigint,dl:int>"


def counted_words(chunks: DataFrame, lower: bool) -> DataFrame:
    """Put dl, terms (term, tf; in order) in place of the text. A row's words are sorted and their runs measured, so that no rows of words are made."""
    ws = F.sort_array(F.coalesce(tokens(F.col("text"), lower), F.array().cast("array<string>")))
    counted = F.transform(F.array(ws), lambda w: F.struct(F.size(w).alias("dl"), runs(w).alias("terms")))[0]
    return chunks.withColumn("_c", counted).select(*[c for c in chunks.columns if c != "text"], "_c.dl", "_c.terms")


def runs(w: Column) -> Column:
    """Each word of a sorted array and how often it comes."""
    last = F.size(w) - 1
    ends = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (last >= 0) & ((i == last) | (F.get(w, i) != F.get(w, i + 1))))
    count = lambda e: lambda end, i: F.struct(F.get(w, end).alias("term"), (end - F.coalesce(F.get(e, i - 1), F.lit(-1))).cast("long").alias("tf"))
    return F.transform(F.array(ends), lambda e: F.transform(e, count(e)))[0]


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, blocks: int, lower: bool):
        self.spark, self.path, self.n_blocks, self.lower, self.labels = spark, path, blocks, lower, None
        self.tables = {t: KeyedTable.open(spark, f"{path}/{t}") for t in TABLES}

    @classmethod
    def build(cls, chunks: DataFrame, path: str, blocks: int = 1024, buckets: int = 64, lower: bool = True) -> KeywordIndex:
        """A new index of chunks (scope, chunk_id, text). blocks: a multiple of buckets; a block should hold some dozen chunks or more."""
        if blocks % buckets:
            raise ValueError("blocks must be a multiple of buckets")
        spark, kinds = chunks.sparkSession, dict(chunks.dtypes)
        scope, kind = kinds["scope"], kinds["chunk_id"]
        make = lambda name, ddl, keys, by=None, n=buckets: KeyedTable.create(spark, f"{path}/{name}", ddl, keys, by, n)
        make("chunks", f"block int, scope {scope}, chunk_id {kind}, dl int, terms array<struct<term:string,tf:bigint>>", ["block", "scope", "chunk_id"], ["block"])
        make("blocks", f"block int, scope {scope}, term string, n bigint, most_tf bigint, least_dl int, docs array<{POSTING.format(kind=kind)}>", ["block", "scope", "term"], ["block"])
        make("terms", f"scope {scope}, term string, df bigint", ["scope", "term"])
        make("scopes", f"scope {scope}, n bigint, words bigint", ["scope"], n=1)
        out = cls(spark, path, blocks, lower)
        out.change(chunks)
        return out

    def block(self) -> Column:
        """A chunk's block. Blocks are numbered so that each bucket of a table kept by block has as many."""
        if self.labels is None:
            buckets = self.tables["chunks"].buckets
            ids = self.spark.range(100 * self.n_blocks).select(F.col("id").cast("int").alias("block")).withColumn("bucket", F.pmod(F.hash("block"), F.lit(buckets)))
            dealt = top(ids, self.n_blocks // buckets, ["block"], ["bucket"])
            self.labels = sorted(r["block"] for r in dealt.select("block").collect())  # n_blocks numbers
        return F.get(F.lit(self.labels), F.pmod(F.hash("scope", "chunk_id"), F.lit(len(self.labels))))

    def change(self, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Insert or replace chunks (scope, chunk_id, text) and remove those of `gone` (scope, chunk_id).

        Of repeated rows of one key the first by text counts. A chunk that is both changed and gone is gone.
        """
        spark, held, keys = self.spark, self.tables["chunks"], ["block", "scope", "chunk_id"]
        stage = shared.fresh_dir(spark, "change")
        empty = not held.manifest()["current"]
        present = "scope IS NOT NULL AND chunk_id IS NOT NULL"
        if chunks is None:
            staged = held.stage(spark.createDataFrame([], held.schema), single=True)
        else:
            texts = chunks.where(present).select(self.block().alias("block"), "scope", "chunk_id", "text").repartition(held.buckets, "block")
            first = top(texts, 1, ["text"], keys).drop("rank")
            staged = held.stage(counted_words(first, self.lower), single=True)
        new = held.staged(staged)
        if gone is not None:
            gone = shared.written(gone.where(present).select(self.block().alias("block"), "scope", "chunk_id").distinct(), f"{stage}/gone")
            dealt = held.session.read.schema(gone.schema).parquet(f"{stage}/gone").repartition(held.buckets, "block")
            new = new.join(dealt, keys, "left_anti")
        signed = new.withColumn("sign", F.lit(1))
        if not empty:
            was = held.where_it_lies()
            old = was.join(held.staged(staged).select(*keys), keys, "left_semi")
            if gone is not None:
                old = was.join(held.staged(staged).select(*keys).union(dealt).distinct().repartition(held.buckets, "block"), keys, "left_semi")
            signed = signed.unionByName(old.withColumn("sign", F.lit(-1)))
        words = signed.select("scope", "sign", F.explode("terms.term").alias("term")).groupBy("scope", "term").agg(F.sum("sign").alias("df")).where("df <> 0")
        sizes = signed.groupBy("scope").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("words"))
        words, sizes = shared.written(words, f"{stage}/words"), shared.written(sizes, f"{stage}/sizes")

        touched = held.put(staged, gone if gone is None else dealt)
        each = held.where_it_lies(touched).select("block", "scope", "chunk_id", "dl", F.explode("terms").alias("t")).select("block", "scope", F.col("t.term").alias("term"), F.struct("chunk_id", F.col("t.tf").alias("tf"), "dl").alias("doc"))
        docs = each.groupBy("block", "scope", "term").agg(F.count(F.lit(1)).alias("n"), F.max("doc.tf").alias("most_tf"), F.min("doc.dl").alias("least_dl"), F.sort_array(F.collect_list("doc")).alias("docs"))  # a block's chunks
        self.tables["blocks"].refill(touched, docs)
        self.tables["terms"].add(words, ["df"])
        self.tables["scopes"].add(sizes, ["n", "words"])
        shared.delete(spark, stage)

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """terms (scope, term, df, idf), scopes (scope, n, avgdl), as bm25_statistics has them.

        The mean idf of a scope comes from the counts of its words by df, of which there are few.
        """
        scopes = self.tables["scopes"].read().select("scope", "n", (F.col("words") / F.col("n")).alias("avgdl"))
        terms = self.tables["terms"].read()
        raw = lambda: F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        by_df = terms.groupBy("scope", "df").agg(F.count(F.lit(1)).alias("m")).join(scopes, "scope")
        mean = by_df.groupBy("scope").agg((F.sum(F.col("m") * raw()) / F.sum("m")).alias("mean"))
        met = terms.join(scopes.join(mean, "scope"), "scope")
        return met.select("scope", "term", "df", F.when(raw() < 0, EPSILON * F.col("mean")).otherwise(raw()).alias("idf")), scopes

    def weighted(self, questions: DataFrame) -> DataFrame:
        """question_id, scope, term, w, avgdl: the words of the questions that the index has, and their weights."""
        words = questions.select("question_id", "scope", F.explode(tokens(F.col("text"), self.lower)).alias("term"))
        asked = words.groupBy("question_id", "scope", "term").agg(F.count(F.lit(1)).alias("times"))
        terms, scopes = self.statistics()
        return asked.join(terms, ["scope", "term"]).join(scopes, "scope").select("question_id", "scope", "term", (F.col("times") * F.col("idf")).alias("w"), "avgdl")

    def topk(self, questions: DataFrame, k: int, keep_zero: bool = False, first_blocks: int = 16) -> DataFrame:
        """question_id, scope, chunk_id, score, rank, as bm25_topk gives them. questions: question_id, scope, text."""
        stage = shared.fresh_dir(self.spark, "search")
        found, _ = self._searched(questions, k, keep_zero, first_blocks, stage)
        return top(found, k, [F.desc(F.round("score", 9)), "chunk_id"])

    def search_report(self, questions: DataFrame, k: int, keep_zero: bool = False, first_blocks: int = 16) -> DataFrame:
        """question_id, postings (of the question's words), postings_read: what the bounds spared."""
        stage = shared.fresh_dir(self.spark, "search")
        _, read = self._searched(questions, k, keep_zero, first_blocks, stage)
        return read

    def _searched(self, questions: DataFrame, k: int, keep_zero: bool, first_blocks: int, stage: str) -> tuple[DataFrame, DataFrame]:
        weighted = shared.written(self.weighted(questions), f"{stage}/words")
        blocks = self.tables["blocks"].read()
        summaries = blocks.select("block", "scope", "term", "n", "most_tf", "least_dl")
        reach = F.greatest("w", F.lit(0.0)) * part(F.col("most_tf"), F.col("least_dl"))
        met = summaries.join(weighted, ["scope", "term"]).groupBy("question_id", "scope", "block").agg(F.sum(reach).alias("bound"), F.sum("n").alias("postings"))
        order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "scope", "block")
        bounds = shared.written(met.withColumn("place", F.row_number().over(order)), f"{stage}/bounds")

        def scored(pairs: DataFrame) -> DataFrame:
            """Each question's k best of every block, found where the block lies."""
            wanted = pairs.select("question_id", "scope", "block").join(weighted, ["question_id", "scope"])
            lying = self.tables["blocks"].where_it_lies().select("block", "scope", "term", "docs")
            hits = lying.join(wanted, ["block", "scope", "term"]).select("question_id", "scope", "block", "w", "avgdl", F.explode("docs").alias("d"))
            sums = hits.groupBy("question_id", "scope", "block", F.col("d.chunk_id").alias("chunk_id")).agg(F.sum(F.col("w") * part(F.col("d.tf"), F.col("d.dl"))).alias("score"))
            kept = sums if keep_zero else sums.where("score > 0")
            return top(kept, k, [F.desc(F.round("score", 9)), "chunk_id"], ["question_id", "scope", "block"]).select("question_id", "scope", "chunk_id", "score")

        def held(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{stage}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{stage}/{name}")

        early = held(scored(bounds.where(F.col("place") <= first_blocks)), "early")
        kth = top(early, k, [F.desc("score"), "chunk_id"]).where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
        late = bounds.where(F.col("place") > first_blocks).join(kth, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
        late = shared.written(late.select("question_id", "scope", "block"), f"{stage}/late")
        used = bounds.where(F.col("place") <= first_blocks).select("question_id", "scope", "block").union(late).withColumn("used", F.lit(True))
        read = bounds.join(used, ["question_id", "scope", "block"], "left").groupBy("question_id").agg(F.sum("postings").alias("postings"), F.sum(F.when(F.col("used"), F.col("postings")).otherwise(0)).alias("postings_read"))
        return early.unionByName(held(scored(late), "rest")), read


def part(tf: Column, dl: Column) -> Column:
    """What a count and a length make of a word's weight; grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
