"""Queries of document preparation, retrieval and image choice over derived pages and questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunks, ground, rank, retrieve
from ..functions import rules
from ..sources import shared
from .registry import query, table
from .texts import PAIRS_SQL, answer_pairs, cases, has, listed, quoted  # noqa: F401


def docs(spark, d):
    return table(spark, d, "documents")


def marked_text(documents):
    """Every fifth document with page marks in place of line ends."""
    return documents.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit(" <!-- page 2 --> "))).otherwise(F.col("text")))


def marked_pages(documents):
    return chunks.split_markdown_pages(marked_text(documents))


def pages(spark, d):
    return marked_pages(docs(spark, d))


BLANK = "trim(regexp_replace(p, '\\s+', ' ', 'g')) <> ''"
PAGES_SQL = (
    "(WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), ' <!-- page 2 --> ') ELSE text END AS text FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)<!--\\s*page\\s+\\d+\\s*-->') THEN regexp_split_to_array(text, '(?i)<!--\\s*page\\s+\\d+\\s*-->') ELSE list_transform(range(0, greatest(1, ((length(text) + 2999) // 3000))), lambda i: substr(text, i * 3000 + 1, 3000)) END AS ps FROM m), "
    f"k AS (SELECT doc_id, list_filter(ps, lambda p: {BLANK}) AS ps FROM s) SELECT doc_id, unnest(range(1, len(ps) + 1))::INT AS page, unnest(ps) AS text FROM k)"
)


@query(f"SELECT * FROM {PAGES_SQL}")
def split_markdown_pages(spark, d):
    return pages(spark, d)


def candidates(spark, d):
    part = F.col("doc_id") % 4
    return docs(spark, d).select("doc_id", F.lit(1).alias("page"), F.when(part == 0, "").when(part == 1, "  ").otherwise(F.col("text")).alias("odl"), F.when(part == 0, F.replace("text", F.lit("e"), F.lit("�"))).alias("plumber"), F.when(part == 1, F.lit(None)).otherwise(F.col("text")).cast("string").alias("plain"), F.when(F.col("doc_id") % 8 == 1, F.upper("source")).alias("ocr"))


CANDIDATES_SQL = "(SELECT doc_id, 1::INT AS page, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE text END AS odl, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'e', chr(65533)) END AS plumber, CASE WHEN doc_id % 4 <> 1 THEN text END AS plain, CASE WHEN doc_id % 8 = 1 THEN upper(source) END AS ocr FROM documents)"
OCR_SQL = "coalesce(length(trim({c})) = 0 OR (length({c}) - length(replace({c}, chr(65533), ''))) / length({c}) > 0.4, TRUE)"


@query(f"WITH f AS (SELECT *, coalesce(CASE WHEN trim(odl) <> '' THEN odl END, CASE WHEN trim(plumber) <> '' THEN plumber END, CASE WHEN trim(plain) <> '' THEN plain END, '') AS first, CASE WHEN trim(odl) <> '' THEN 'odl' WHEN trim(plumber) <> '' THEN 'plumber' ELSE 'plain' END AS m FROM {CANDIDATES_SQL}), u AS (SELECT *, {OCR_SQL.format(c='first')} AND coalesce(trim(ocr) <> '', FALSE) AS o FROM f) SELECT doc_id, page, CASE WHEN o THEN ocr ELSE first END AS text, CASE WHEN o THEN 'ocr' ELSE m END AS method FROM u WHERE trim(CASE WHEN o THEN ocr ELSE first END) <> ''")
def select_page_text(spark, d):
    return chunks.select_page_text(candidates(spark, d))


@query(f"SELECT doc_id, {OCR_SQL.format(c='plumber')} AS needs_ocr FROM {CANDIDATES_SQL}")
def needs_ocr(spark, d):
    return candidates(spark, d).select("doc_id", chunks.needs_ocr(F.col("plumber")).alias("needs_ocr"))


@query("SELECT doc_id, CASE WHEN length(l) < 80 THEN l ELSE '' END AS heading FROM (SELECT doc_id, trim(list_extract(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1)) AS l FROM documents)")
def section_heading(spark, d):
    return docs(spark, d).select("doc_id", chunks.section_heading(F.col("text")).alias("heading"))


def cells(spark, d):
    """Order rows as cells of tables: a table for each customer and status."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("page"), (F.col("o_orderkey") % 2).cast("int").alias("table_idx"), F.col("o_orderkey").alias("row_idx"), "o_orderstatus", "o_orderpriority", "o_orderkey")
    value = F.array(F.struct(F.lit(0).alias("col_idx"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("cell")), F.struct(F.lit(1).alias("col_idx"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).otherwise("  ").alias("cell")))
    return o.select("doc_id", "page", "table_idx", "row_idx", F.explode(value).alias("c")).select("doc_id", "page", "table_idx", "row_idx", "c.*")


ROWS_SQL = "(SELECT o_custkey AS doc_id, (o_orderkey % 3)::INT AS page, (o_orderkey % 2)::INT AS table_idx, o_orderkey AS row_idx, CASE WHEN o_orderkey % 7 <> 0 THEN trim(o_orderpriority) ELSE '' END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN trim(o_orderstatus) ELSE '' END AS b FROM orders)"


@query(f"SELECT doc_id, page, string_agg(a || ' | ' || b, chr(10) ORDER BY table_idx, row_idx) AS text FROM {ROWS_SQL} WHERE a <> '' OR b <> '' GROUP BY 1, 2")
def flatten_tables(spark, d):
    return chunks.flatten_tables(cells(spark, d))


@query(f"WITH t AS (SELECT doc_id, page, table_idx, list('| ' || a || ' | ' || b || ' |' ORDER BY row_idx) AS l, bool_or(a <> '' OR b <> '') AS s FROM {ROWS_SQL} GROUP BY 1, 2, 3) SELECT doc_id, page, table_idx, '[TABLE on page ' || page || ']' || chr(10) || array_to_string(list_concat([l[1], '| --- | --- |'], l[2:]), chr(10)) AS text FROM t WHERE s")
def table_nodes(spark, d):
    return chunks.table_nodes(cells(spark, d))


def images(spark, d):
    """documents as images: lang is the document, the text's bytes the content."""
    ext = F.when(F.col("doc_id") % 11 == 0, "svg").otherwise("png")
    return docs(spark, d).select(F.col("lang").alias("doc_id"), (F.col("doc_id") % 50).cast("int").alias("page"), F.col("doc_id").alias("img_idx"), F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), ext.alias("ext"), F.encode("text", "UTF-8").alias("bytes"))


@query("SELECT doc_id, hash, page, img_idx, 'img_' || img_idx || '.png' AS filename, ext, size FROM (SELECT lang AS doc_id, md5(text) AS hash, (doc_id % 50)::INT AS page, doc_id AS img_idx, CASE WHEN doc_id % 11 = 0 THEN 'svg' ELSE 'png' END AS ext, octet_length(encode(text))::INT AS size, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id % 50, doc_id) AS k FROM documents WHERE octet_length(encode(text)) >= 1024) WHERE k = 1 AND ext <> 'svg'")
def unique_images(spark, d):
    return chunks.unique_images(images(spark, d), 1024)


@query("SELECT lang AS doc_id, (doc_id % 50)::INT AS page, doc_id AS img_idx, '[IMAGE on page ' || (doc_id % 50) || '] Filename: img_' || doc_id || '.png' AS text FROM documents")
def image_nodes(spark, d):
    return chunks.image_nodes(images(spark, d))


@query("SELECT doc_id, substr(regexp_replace(trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g')), '[^\\x{20}-\\x{7e}\\x{c0}-\\x{24f}]', '', 'g'), 1, 400) AS caption FROM documents")
def clean_caption(spark, d):
    return docs(spark, d).select("doc_id", chunks.clean_caption(F.col("text")).alias("caption"))


def boxes(spark, d):
    """Line items as boxes on pages: (images, texts)."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("b")
    block = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kept = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 997).alias("doc_id"), (F.col("l_suppkey") % 5).cast("int").alias("page"), block.alias("block_id")).agg(first).select("doc_id", "page", "block_id", "b.*")
    x0, y0 = (F.col("l_partkey") % 400).cast("double"), (F.col("l_extendedprice") % 700).cast("int").cast("double")
    text = F.concat(F.lit("block "), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_partkey").cast("string"))
    made = kept.select("doc_id", "page", "block_id", "l_linenumber", x0.alias("x0"), y0.alias("y0"), (x0 + 80 + F.col("l_quantity")).alias("x1"), (y0 + 15 + F.col("l_quantity")).alias("y1"), text.alias("text"))
    one = shared.written(made, shared.fresh_dir(spark, "boxes"))  # read several times
    return one.where("l_linenumber = 1").select("doc_id", "page", F.col("block_id").alias("img_id"), "x0", "y0", "x1", "y1"), one.where("l_linenumber > 1").select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1", "text")


BOXES_SQL = "(SELECT doc_id, page, block_id, n, x0, y0, x0 + 80 + q AS x1, y0 + 15 + q AS y1, text FROM (SELECT l_orderkey % 997 AS doc_id, (l_suppkey % 5)::INT AS page, l_orderkey * 10 + l_linenumber AS block_id, l_linenumber AS n, (l_partkey % 400)::DOUBLE AS x0, trunc(l_extendedprice % 700)::DOUBLE AS y0, l_quantity AS q, 'block ' || l_orderkey || ' ' || l_partkey AS text, row_number() OVER (PARTITION BY l_orderkey % 997, l_suppkey % 5, l_orderkey * 10 + l_linenumber ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1)"


@query(
    f"WITH b AS {BOXES_SQL}, m AS (SELECT i.doc_id, i.page, i.block_id AS img_id, t.block_id, t.text, t.y0 - i.y1 AS below, i.y0 - t.y1 AS above, CASE WHEN least(i.x1, t.x1) - greatest(i.x0, t.x0) <= 0 THEN 0 ELSE (least(i.x1, t.x1) - greatest(i.x0, t.x0)) / greatest(t.x1 - t.x0, 1) END > 0.2 AS w, "
    "least(i.y1, t.y1) - greatest(i.y0, t.y0) AS tall, t.x0 - i.x1 AS r, i.x0 - t.x1 AS l, abs((t.y0 + t.y1) / 2 - (i.y0 + i.y1) / 2) AS far FROM b i JOIN b t ON i.doc_id = t.doc_id AND i.page = t.page AND i.n = 1 AND t.n > 1 WHERE length(t.text) >= 8), "
    "f AS (SELECT doc_id, page, img_id, first(text ORDER BY below, block_id) FILTER (below BETWEEN 0 AND 60 AND w) AS u, first(text ORDER BY above, block_id) FILTER (above BETWEEN 0 AND 40 AND w) AS o, "
    "substr(array_to_string((list(text ORDER BY far, block_id) FILTER (tall > 20 AND (r BETWEEN 0 AND 150 OR l BETWEEN 0 AND 150)))[1:2], ' '), 1, 300) AS side, first(text ORDER BY far, block_id) FILTER (far = far) AS near, min(far) AS nd, substr(string_agg(text, chr(10) ORDER BY block_id), 1, 400) AS whole FROM m GROUP BY 1, 2, 3), "
    "c AS (SELECT *, coalesce(u, o) AS direct, coalesce(u, o, side) AS caption FROM f), "
    "o AS (SELECT b.doc_id, b.page, b.block_id AS img_id, caption, coalesce(CASE WHEN direct IS NOT NULL THEN side END, CASE WHEN nd < 120 THEN near END, CASE WHEN caption IS NULL THEN whole END) AS context, trim(split_part(whole, chr(10), 1)) AS head FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.page = c.page AND b.block_id = c.img_id WHERE b.n = 1) "
    "SELECT doc_id, page, img_id, caption, context, nullif(concat_ws(' | ', CASE WHEN regexp_matches(lower(head), 'author|reviewer|about|editor') THEN 'Page heading: ' || substr(head, 1, 80) END, 'Caption/bio: ' || substr(caption, 1, 300), CASE WHEN context IS DISTINCT FROM caption THEN 'Nearby text: ' || substr(context, 1, 200) END), '') AS combined FROM o"
)
def attach_captions(spark, d):
    return chunks.attach_captions(*boxes(spark, d))


def _windows_sql(source: str, keys: str, text: str, size: int, overlap: int, idx: str, out: str) -> str:
    step = size - overlap
    return f"(SELECT {keys}, unnest(range(len(cs)))::INT AS {idx}, unnest(cs) AS {out} FROM (SELECT *, CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(0, greatest(1, ((len(ws) - {overlap} + {step} - 1) // {step}))), lambda i: array_to_string(ws[i * {step} + 1 : i * {step} + {size}], ' ')) END AS cs FROM (SELECT *, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '') AS ws FROM {source})))"


@query(f"SELECT doc_id, page, chunk, c AS text FROM {_windows_sql(PAGES_SQL, 'doc_id, page', 'text', 512, 64, 'chunk', 'c')}")
def chunk_windows(spark, d):
    return chunks.chunk_windows(pages(spark, d))


PARENTS_SQL = f"(SELECT *, 'parent_p' || page || '_' || parent_idx || '_' || substr(md5(substr(parent_text, 1, 200)), 1, 12) AS parent_id FROM {_windows_sql(PAGES_SQL, 'doc_id, page', 'text', 512, 64, 'parent_idx', 'parent_text')})"
CHUNKS_SQL = f"(SELECT doc_id, page, parent_idx, parent_id, child_idx, 'child_p' || page || '_' || parent_idx || '_' || child_idx || '_' || substr(md5(substr(text, 1, 200)), 1, 12) AS chunk_id, text, parent_text FROM {_windows_sql(PARENTS_SQL, 'doc_id, page, parent_idx, parent_id, parent_text', 'parent_text', 128, 16, 'child_idx', 'text')})"


@query(f"SELECT * FROM {CHUNKS_SQL}")
def hierarchical_chunks(spark, d):
    return chunks.hierarchical_chunks(pages(spark, d))


@query()
def chunk_sentences(spark, d):
    return chunks.chunk_sentences(pages(spark, d))


@query(f"SELECT doc_id, count(*) AS n_nodes, count(*) AS n_text, 0::BIGINT AS n_table, 0::BIGINT AS n_image, count(DISTINCT parent_id) AS n_parents FROM {CHUNKS_SQL} GROUP BY 1")
def document_stats(spark, d):
    return chunks.document_stats(chunks.hierarchical_chunks(pages(spark, d)).select("doc_id", "parent_id", F.lit("text").alias("source_type")))


@query(f"SELECT source_type, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'text' AS source_type, text FROM {CHUNKS_SQL} UNION ALL SELECT 'image', '[IMAGE on page ' || (doc_id % 50) || '] Filename: img_' || doc_id || '.png' FROM documents UNION ALL SELECT 'table', text FROM (WITH t AS (SELECT doc_id, page, table_idx, list('| ' || a || ' | ' || b || ' |' ORDER BY row_idx) AS l, bool_or(a <> '' OR b <> '') AS s FROM {ROWS_SQL} GROUP BY 1, 2, 3) SELECT '[TABLE on page ' || page || ']' || chr(10) || array_to_string(list_concat([l[1], '| --- | --- |'], l[2:]), chr(10)) AS text FROM t WHERE s)) GROUP BY 1")
def union_nodes(spark, d):
    text = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    nodes = chunks.union_nodes(text(hierarchical_chunks(spark, d)), text(table_nodes(spark, d)), image_nodes(spark, d))
    return nodes.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def sentence_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("doc_id"), (F.col("vec_id") % 25).alias("pos"), "embedding")


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
COS = f"({DOT.format(a='{a}', b='{b}')} / (sqrt({DOT.format(a='{a}', b='{a}')}) * sqrt({DOT.format(a='{b}', b='{b}')})))"


@query(f"WITH s AS (SELECT vec_id // 25 AS doc_id, vec_id % 25 AS pos, embedding AS e FROM embeddings), l AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS x FROM s), t AS (SELECT *, 1 - {COS.format(a='e', b='x')} AS step FROM l), p AS (SELECT doc_id, quantile_cont(step, 0.85) AS edge FROM t GROUP BY 1), k AS (SELECT t.doc_id, pos, coalesce(lag(step > edge) OVER (PARTITION BY t.doc_id ORDER BY pos), FALSE)::INT AS b FROM t JOIN p USING (doc_id)), c AS (SELECT doc_id, pos, sum(b) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS chunk FROM k) SELECT doc_id, chunk, count(*) AS n_sentences, min(pos) AS first_pos FROM c GROUP BY 1, 2")
def semantic_chunks(spark, d):
    return chunks.semantic_chunks(sentence_vectors(spark, d))


@query()
def embed(spark, d):
    return chunks.embed(docs(spark, d).select("doc_id", "text"), "text").select("doc_id", "embedding")


def scoped(spark, d):
    """Documents with their language as scope; questions (benchmark texts) go to every scope."""
    return docs(spark, d).select(F.col("lang").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")


def benchmark(spark, d):
    scopes = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), scopes.alias("scope"), "text")


TOKENS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def _bm25_cte(docs_sql: str, lower: bool = True) -> str:
    text = "lower(text)" if lower else "text"
    return (
        f"d AS (SELECT scope, chunk_id, {TOKENS.format(c=text)} AS ws FROM {docs_sql}), sc AS (SELECT scope, count(*) AS n, avg(len(ws)) AS avgdl FROM d GROUP BY 1), "
        "po AS (SELECT scope, chunk_id, dl, term, count(*) AS tf FROM (SELECT scope, chunk_id, len(ws) AS dl, unnest(ws) AS term FROM d) GROUP BY ALL), df AS (SELECT scope, term, count(*) AS df FROM po GROUP BY 1, 2), "
        "ra AS (SELECT df.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN sc USING (scope)), te AS (SELECT scope, term, df, avgdl, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY scope) ELSE r END AS idf FROM ra), "
        f"qt AS (SELECT question_id, scope, term, count(*) AS times FROM (SELECT question_id, scope, unnest({TOKENS.format(c=text)}) AS term FROM q) GROUP BY ALL), "
        "bm AS (SELECT question_id, scope, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM po JOIN te USING (scope, term) JOIN qt USING (scope, term) GROUP BY ALL)"
    )


DOCS_SQL = "(SELECT lang AS scope, doc_id AS chunk_id, text FROM documents)"
Q_SQL = "q AS (SELECT item_id AS question_id, unnest(['en','fr','de','es']) AS scope, text FROM benchmark)"


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)} SELECT scope, term, df, round(idf, 6) AS idf FROM te")
def bm25_index(spark, d):
    return retrieve.bm25_index(scoped(spark, d))[1].withColumn("idf", F.round("idf", 6))


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)} SELECT scope, chunk_id, term, tf, dl FROM po")
def bm25_postings(spark, d):
    return retrieve.bm25_index(scoped(spark, d))[0]


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)} SELECT scope, n, round(avgdl, 6) AS avgdl FROM sc")
def bm25_scopes(spark, d):
    return retrieve.bm25_index(scoped(spark, d))[2].withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {Q_SQL}, {_bm25_cte(DOCS_SQL)}, rk AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM bm WHERE score > 0) SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieve.bm25_topk(benchmark(spark, d), scoped(spark, d), 10).select("question_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {Q_SQL}, {_bm25_cte('(SELECT * FROM ' + DOCS_SQL + ' WHERE length(text) > 30)', False)}, rk AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM bm) SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 5")
def eval_contexts(spark, d):
    base = scoped(spark, d).where(F.length("text") > 30)
    return retrieve.bm25_topk(benchmark(spark, d), base, 5, lower=False, keep_zero=True).select("question_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_questions(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


@query(f"SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10")
def dense_topk(spark, d):
    return retrieve.dense_topk(vector_questions(spark, d), vectors(spark, d), 10).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def dense_topk_lsh(spark, d):
    return retrieve.dense_topk_lsh(vector_questions(spark, d), vectors(spark, d), 10)


def lanes(spark, d):
    """Lanes of documents for each benchmark item: by the item's vector among vectors, and by its words among all documents."""
    asked = table(spark, d, "embeddings").join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = retrieve.dense_topk(asked.select(F.col("vec_id").alias("question_id"), "embedding"), vectors(spark, d), 14)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("all").alias("scope"), "text")
    base = docs(spark, d).select(F.lit("all").alias("scope"), F.col("doc_id").alias("chunk_id"), "text")
    return dense, retrieve.bm25_topk(questions, base, 14)


LANES_CTE = (
    "q AS (SELECT item_id AS question_id, 'all' AS scope, text FROM benchmark), "
    f"ds AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b), "
    "dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM ds) WHERE rank <= 14), "
    + _bm25_cte("(SELECT 'all' AS scope, doc_id AS chunk_id, text FROM documents)")
    + ", kw AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 14)"
)
MERGED_CTE = LANES_CTE + ", un AS (SELECT question_id, chunk_id, rank, 0 AS lane FROM dn UNION ALL SELECT question_id, chunk_id, rank, 1 FROM kw), mg AS (SELECT question_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(lane * 1000 + rank) AS f FROM un GROUP BY 1, 2), rr AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, f, chunk_id) AS rank FROM mg) WHERE rank <= 14)"


@query(f"WITH {MERGED_CTE} SELECT question_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM rr")
def rrf_merge(spark, d):
    return retrieve.rrf_merge(list(lanes(spark, d)), 14).withColumn("score", F.round("score", 6))


def merged_hits(spark, d):
    hits = retrieve.rrf_merge(list(lanes(spark, d)), 14)
    text = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return retrieve.with_texts(hits, text)


HITS_CTE = MERGED_CTE + ", hi AS (SELECT rr.*, d.text, d.source FROM rr JOIN documents d ON d.doc_id = rr.chunk_id)"


@query(f"WITH {HITS_CTE} SELECT question_id, chunk_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(trim(substr(text, 1, 80))) ORDER BY rank) AS k FROM hi) WHERE k = 1")
def dedup_prefix(spark, d):
    return retrieve.dedup_prefix(merged_hits(spark, d)).select("question_id", "chunk_id", "rank")


@query(f"WITH {LANES_CTE}, un AS (SELECT question_id, 0 AS sub_idx, chunk_id, rank FROM dn UNION ALL SELECT question_id, 1, chunk_id, rank FROM kw), hi AS (SELECT un.*, d.text FROM un JOIN documents d ON d.doc_id = un.chunk_id), k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(trim(substr(text, 1, 80))) ORDER BY sub_idx, rank) AS k FROM hi) WHERE k = 1) SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY sub_idx, rank)::INT AS pos FROM k1")
def multi_query(spark, d):
    dense, keyword = lanes(spark, d)
    both = retrieve.lane_rows(dense, 0).unionByName(retrieve.lane_rows(keyword, 1)).withColumnRenamed("lane", "sub_idx")
    text = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.multi_query(retrieve.with_texts(both, text)).select("question_id", "chunk_id", "pos")


def child_hits(spark, d):
    """Children of the hit documents as hits, in the order of the document's rank and of the child."""
    nodes = chunks.hierarchical_chunks(pages(spark, d)).select("doc_id", "page", F.col("chunk_id").alias("node_id"), "parent_id", "text", "parent_idx", "child_idx")
    hits = retrieve.rrf_merge(list(lanes(spark, d)), 14).select("question_id", F.col("chunk_id").alias("doc_id"), "rank", "score")
    met = hits.join(nodes, "doc_id")
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "page", "parent_idx", "child_idx"))
    return met.select("question_id", "doc_id", "page", F.col("node_id").alias("chunk_id"), "parent_id", pos.alias("pos"), "score", "text")


CHILD_CTE = MERGED_CTE + f", no AS {CHUNKS_SQL}, ch AS (SELECT rr.question_id, no.doc_id, no.page, no.chunk_id, no.parent_id, no.parent_text, row_number() OVER (PARTITION BY rr.question_id ORDER BY rr.rank, page, parent_idx, child_idx)::INT AS pos, rr.score, no.text FROM rr JOIN no ON no.doc_id = rr.chunk_id)"


@query(f"WITH {CHILD_CTE} SELECT question_id, doc_id, chunk_id, pos, parent_text AS text FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, parent_id ORDER BY pos) AS k FROM ch) WHERE k = 1")
def expand_to_parents(spark, d):
    parents = chunks.hierarchical_chunks(pages(spark, d)).select("doc_id", "parent_id", F.col("parent_text").alias("text")).distinct()
    return retrieve.expand_to_parents(child_hits(spark, d), parents).select("question_id", "doc_id", "chunk_id", "pos", "text")


@query(f"WITH {LANES_CTE}, s AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM dn), t AS (SELECT *, list_sort(list(score) OVER (PARTITION BY question_id)) AS v FROM s WHERE rank <= 5) SELECT question_id, chunk_id, rank::INT AS rank FROM t WHERE len(v) <= 3 OR score >= v[len(v) // 3 + 1]")
def precision_cutoff(spark, d):
    return rank.precision_cutoff(lanes(spark, d)[0].select("question_id", "chunk_id", "score")).select("question_id", "chunk_id", "rank")


def context_hits(spark, d):
    kind = F.when(F.col("chunk_id") % 7 == 0, "table").when(F.col("chunk_id") % 11 == 0, "image").otherwise("text")
    return merged_hits(spark, d).select("question_id", F.col("rank").alias("pos"), (F.col("chunk_id") % 30).cast("int").alias("page"), kind.alias("source_type"), F.when(F.col("chunk_id") % 2 == 0, F.col("source")).otherwise("").alias("section_heading"), "text")


CONTEXT_CTE = HITS_CTE + ", cx AS (SELECT question_id, rank AS pos, (chunk_id % 30)::INT AS page, CASE WHEN chunk_id % 7 = 0 THEN 'table' WHEN chunk_id % 11 = 0 THEN 'image' ELSE 'text' END AS source_type, CASE WHEN chunk_id % 2 = 0 THEN source ELSE '' END AS section_heading, text FROM hi)"


@query(f"WITH {CONTEXT_CTE}, b AS (SELECT question_id, string_agg(CASE WHEN source_type = 'table' THEN '[Table on Page ' || page || ']' ELSE '[Page ' || page || CASE WHEN section_heading <> '' THEN ' | ' || section_heading ELSE '' END || ']' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY source_type = 'table', pos) AS context FROM cx WHERE source_type <> 'image' GROUP BY 1) SELECT item_id AS question_id, coalesce(context, 'No context found.') AS context FROM benchmark LEFT JOIN b ON question_id = item_id")
def build_context(spark, d):
    return retrieve.build_context(table(spark, d, "benchmark").select(F.col("item_id").alias("question_id")), context_hits(spark, d))


@query(f"WITH {CONTEXT_CTE}, n AS (SELECT question_id, count(*) AS n FROM cx GROUP BY 1), s AS (SELECT cx.question_id, pos, text, ((pos - 1) // greatest(1, n // 3))::INT AS sub_idx FROM cx JOIN n USING (question_id)), k AS (SELECT *, row_number() OVER (PARTITION BY question_id, sub_idx ORDER BY pos) AS k FROM s), p AS (SELECT question_id, sub_idx, '### part ' || sub_idx || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY pos) AS part FROM k WHERE k <= 3 AND sub_idx < 3 GROUP BY 1, 2) SELECT question_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY sub_idx) AS context FROM p GROUP BY 1")
def build_subquery_context(spark, d):
    subs = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sub_idx"))
    return retrieve.build_subquery_context(context_hits(spark, d), subs.withColumn("sub_text", F.concat(F.lit("part "), F.col("sub_idx").cast("string"))))


@query(f"WITH {CONTEXT_CTE} SELECT question_id, list_sort(list(DISTINCT page)) AS pages FROM cx GROUP BY 1")
def source_pages(spark, d):
    return retrieve.source_pages(context_hits(spark, d))


@query(f"WITH {CONTEXT_CTE} SELECT question_id, count(*) FILTER (source_type = 'text') AS n_text, count(*) FILTER (source_type = 'table') AS n_table, count(*) FILTER (source_type = 'image') AS n_image, list_sort(list(DISTINCT page)) AS pages FROM cx GROUP BY 1")
def split_by_source(spark, d):
    return retrieve.split_by_source(context_hits(spark, d))


QWORDS = "list_filter(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))), lambda w: NOT list_contains({stop}, w))"
KINDS = ("factoid", "general", "analytical", "summary")


def adaptive_hits(spark, d):
    dense, keyword = lanes(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.get(F.array(*[F.lit(t) for t in KINDS]), (F.col("item_id") % 4).cast("int")).alias("query_type"))
    return retrieve.adaptive_retrieve(rules.retrieval_budget(q), dense, keyword, docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))


def _adaptive_cte() -> str:
    budgets = "CASE kind " + " ".join(f"WHEN '{k}' THEN {list(rules.BUDGETS[k])}" for k in KINDS) + " END"
    words = "list_filter(regexp_split_to_array(coalesce(found, ''), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
    tried = lambda r, c: f"'round{r}_k=' || ks[{r}] || ' conf=' || format('{{:.3f}}', {c})"
    return (
        f"bk AS (SELECT *, {budgets} AS ks FROM (SELECT item_id AS question_id, text, {list(KINDS)}[(item_id % 4 + 1)::INT] AS kind FROM benchmark)), dp AS (SELECT question_id, text, unnest([0, 1, 2]) AS round, unnest(ks) AS k FROM bk), "
        "au AS (SELECT question_id, chunk_id, rank, 0 AS lane FROM dn UNION ALL SELECT question_id, chunk_id, rank, 1 FROM kw), fu AS (SELECT au.question_id, round, k, chunk_id, sum(1.0 / (60 + rank)) AS score, min(lane * 1000 + rank) AS f FROM au JOIN dp USING (question_id) WHERE rank <= k GROUP BY ALL), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY question_id, round ORDER BY round(score, 12) DESC, f, chunk_id) AS rank FROM fu), tx AS (SELECT rk.*, d.text FROM rk JOIN documents d ON d.doc_id = rk.chunk_id WHERE rank <= k), "
        "sg AS (SELECT *, row_number() OVER (PARTITION BY question_id, round, lower(trim(substr(text, 1, 80))) ORDER BY rank) AS dup FROM tx), pl AS (SELECT question_id, round, chunk_id, text, row_number() OVER (PARTITION BY question_id, round ORDER BY rank) AS pos FROM sg WHERE dup = 1), "
        "af AS (SELECT question_id, round, string_agg(lower(text), ' ' ORDER BY pos) AS found FROM pl WHERE pos <= 3 GROUP BY 1, 2), ad AS (SELECT question_id, avg(score) AS s FROM dn WHERE rank <= 3 GROUP BY 1), "
        f"aw AS (SELECT dp.question_id, dp.round, dp.text, s, found IS NOT NULL AS hit, {QWORDS.format(c='dp.text', stop=listed(ground.QUESTION_STOP))} AS w, {words} AS fd FROM dp LEFT JOIN af ON af.question_id = dp.question_id AND af.round = dp.round LEFT JOIN ad ON ad.question_id = dp.question_id), "
        f"ac AS (SELECT question_id, round, round(CASE WHEN s IS NULL OR NOT hit THEN 0.0 WHEN regexp_matches(lower(trim(text)), {quoted(rules.any_of(rules.ALWAYS_ANSWER))}) THEN 1.0 ELSE s * 0.65 + CASE WHEN len(w) = 0 THEN 0.5 ELSE len(list_intersect(w, fd)) / len(w) END * 0.35 END, 3) AS c FROM aw), "
        "wd AS (SELECT question_id, max(c) FILTER (round = 0) AS c0, max(c) FILTER (round = 1) AS c1, max(c) FILTER (round = 2) AS c2 FROM ac GROUP BY 1), "
        "ae AS (SELECT bk.question_id, kind, ks, c0, c1, c2, CASE WHEN kind IN ('factoid', 'general') AND c0 >= 0.5 THEN 0 WHEN kind IN ('analytical', 'summary') AND c1 < 0.5 THEN 2 ELSE 1 END AS round FROM bk JOIN wd USING (question_id)), "
        f"al AS (SELECT question_id, round, CASE round WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS confidence, 'type=' || kind || ' budget=(' || ks[1] || ',' || ks[2] || ',' || ks[3] || ') | ' || {tried(1, 'c0')} || ' | ' || CASE WHEN round = 0 THEN 'no_expansion' ELSE {tried(2, 'c1')} END || CASE WHEN round = 2 THEN ' | ' || {tried(3, 'c2')} ELSE '' END AS log FROM ae), "
        "ar AS (SELECT pl.question_id, pl.chunk_id, pl.pos::INT AS pos, al.confidence, al.round::INT AS round, al.log FROM pl JOIN al ON al.question_id = pl.question_id AND al.round = pl.round)"
    )


@query(f"WITH {LANES_CTE}, {_adaptive_cte()} SELECT * FROM ar")
def adaptive_retrieve(spark, d):
    return adaptive_hits(spark, d)


OVERLAP_CTE = HITS_CTE + f", tt AS (SELECT question_id, string_agg(lower(text), ' ' ORDER BY rank) AS found FROM hi WHERE rank <= 3 GROUP BY 1), ow AS (SELECT item_id AS question_id, text, {QWORDS.format(c='text', stop=listed(ground.QUESTION_STOP))} AS w, list_filter(regexp_split_to_array(coalesce(found, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS f FROM benchmark LEFT JOIN tt ON question_id = item_id), ov AS (SELECT question_id, text, CASE WHEN len(w) = 0 THEN 0.5 ELSE len(list_intersect(w, f)) / len(w) END AS overlap FROM ow)"


def benchmark_questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(f"WITH {OVERLAP_CTE} SELECT question_id, round(overlap, 4) AS overlap FROM ov")
def keyword_overlap(spark, d):
    return ground.keyword_overlap(benchmark_questions(spark, d), merged_hits(spark, d)).withColumn("overlap", F.round("overlap", 4))


CONF_CTE = OVERLAP_CTE + f", de AS (SELECT question_id, avg(score) AS s FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS k FROM hi) WHERE k <= 3 GROUP BY 1), cf AS (SELECT ov.question_id, text, s, regexp_matches(lower(trim(text)), {quoted(rules.any_of(rules.ALWAYS_ANSWER))}) AS aa, s * 0.65 + overlap * 0.35 AS m FROM ov LEFT JOIN de USING (question_id)), co AS (SELECT question_id, text, round(CASE WHEN s IS NULL THEN 0.0 WHEN aa THEN 1.0 ELSE m END, 3) AS confidence, CASE WHEN s IS NULL THEN 'no_nodes' WHEN aa THEN 'always_answer' WHEN m < 0.35 THEN 'low_similarity' WHEN m < 0.55 THEN 'borderline' ELSE 'confident' END AS reason FROM cf)"


@query(f"WITH {CONF_CTE} SELECT question_id, confidence, reason FROM co")
def confidence(spark, d):
    return ground.confidence(benchmark_questions(spark, d), merged_hits(spark, d))


def _gate_sql() -> str:
    block = "reason <> 'always_answer' AND confidence < 0.35"
    return f"WITH {CONF_CTE}, g AS (SELECT *, {cases('lower(trim(text))', rules.QUERY_CLASSES, 'ANALYTICAL')} AS query_class FROM co) SELECT question_id, confidence, reason, query_class, NOT ({block}) AS should_answer, CASE WHEN reason <> 'always_answer' AND confidence >= 0.35 AND confidence < 0.55 AND query_class NOT IN ('FACTOID', 'CONVERSATIONAL', 'DEFINITIONAL') THEN {quoted(ground.WARNING)} END AS warning, CASE WHEN {block} THEN {quoted(ground.FALLBACK)} END AS fallback FROM g"


@query(_gate_sql())
def gate(spark, d):
    q = benchmark_questions(spark, d)
    classes = q.select("question_id", rules.classify_query(F.col("text")).alias("query_class"))
    return ground.gate(ground.confidence(q, merged_hits(spark, d)).join(classes, "question_id"))


@query(
    _gate_sql().replace(" SELECT question_id, confidence", ", ga AS (SELECT question_id, confidence").replace(" AS fallback FROM g", " AS fallback FROM g)")
    + f", cx AS (SELECT question_id, (chunk_id % 30)::INT AS page FROM hi), sp AS (SELECT question_id, list_sort(list(DISTINCT page)) AS pages FROM cx GROUP BY 1), {_adaptive_cte()}, lg AS (SELECT DISTINCT question_id, log FROM ar) SELECT item_id AS question_id, {cases('lower(trim(text))', rules.QUERY_TYPES, 'general')} AS query_type, query_class, pages, ga.confidence, should_answer, warning, log AS retrieval_log FROM benchmark LEFT JOIN sp ON sp.question_id = item_id LEFT JOIN ga ON ga.question_id = item_id LEFT JOIN lg ON lg.question_id = item_id"
)
def retrieval_report(spark, d):
    q = benchmark_questions(spark, d)
    kinds = q.select("question_id", rules.query_type(F.col("text")).alias("query_type"), rules.classify_query(F.col("text")).alias("query_class"))
    gated = ground.gate(ground.confidence(q, merged_hits(spark, d)).join(kinds.select("question_id", "query_class"), "question_id"))
    return rank.retrieval_report(kinds, retrieve.source_pages(context_hits(spark, d)), gated, adaptive_hits(spark, d))


IMAGE_QUESTIONS = ["who is the author of this", "what is on the chart", "a photo of the reviewer please"]


def image_questions(spark, d):
    text = F.get(F.array(*[F.lit(x) for x in IMAGE_QUESTIONS]), (F.col("item_id") % 3).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), text.alias("text"), F.when(F.col("item_id") % 3 == 0, "FACTOID").otherwise("ANALYTICAL").alias("query_class"))


def image_hits(spark, d):
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4).cast("int"))
    page = F.explode(F.array((F.col("item_id") % 40 + 3).cast("int"), (F.col("item_id") % 17 + 9).cast("int")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), lang.alias("doc_id"), page.alias("page"))


def image_rows(spark, d):
    caption = F.when(F.col("doc_id") % 5 == 0, "Figure about the author").when(F.col("doc_id") % 5 == 1, "Technical reviewer").when(F.col("doc_id") % 5 == 2, "The author, a portrait")
    return docs(spark, d).select(F.col("lang").alias("doc_id"), (F.col("doc_id") % 50).cast("int").alias("page"), F.col("doc_id").alias("img_idx"), caption.alias("caption"))


IMAGES_CTE = (
    f"iq AS (SELECT item_id AS question_id, {listed(IMAGE_QUESTIONS)}[(item_id % 3 + 1)::INT] AS text, CASE WHEN item_id % 3 = 0 THEN 'FACTOID' ELSE 'ANALYTICAL' END AS query_class FROM benchmark), "
    "ih AS (SELECT item_id AS question_id, ['en','fr','de','es'][(item_id % 4 + 1)::INT] AS doc_id, unnest([item_id % 40 + 3, item_id % 17 + 9])::INT AS page FROM benchmark), "
    "im AS (SELECT lang AS doc_id, (doc_id % 50)::INT AS page, doc_id AS img_idx, CASE doc_id % 5 WHEN 0 THEN 'Figure about the author' WHEN 1 THEN 'Technical reviewer' WHEN 2 THEN 'The author, a portrait' END AS caption FROM documents)"
)


@query(
    f"WITH {IMAGES_CTE}, q AS (SELECT question_id, {has('lower(text)', rank.WIDE_WORDS)} AND query_class = 'FACTOID' AS wide, {has('lower(text)', rank.CAPTION_WORDS)} AS portrait FROM iq), la AS (SELECT doc_id, max(page) AS last FROM im GROUP BY 1), "
    "c AS (SELECT DISTINCT ih.question_id, im.doc_id, im.page, im.img_idx FROM ih JOIN q USING (question_id) JOIN im ON im.doc_id = ih.doc_id JOIN la ON la.doc_id = im.doc_id WHERE (abs(im.page - ih.page) <= CASE WHEN wide THEN 8 ELSE 2 END OR (wide AND (im.page BETWEEN 1 AND 20 OR im.page >= greatest(1, last - 10)))) "
    f"AND NOT (portrait AND {has('lower(coalesce(caption, chr(32)))', rank.NOT_PORTRAIT)})), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY page, img_idx, doc_id) AS k FROM c), lo AS (SELECT question_id, min(page) AS low FROM ih GROUP BY 1) "
    "SELECT k.question_id, doc_id, page, img_idx, row_number() OVER (PARTITION BY k.question_id ORDER BY abs(page - low), k)::INT AS place FROM k JOIN lo USING (question_id) WHERE k <= 5"
)
def candidate_images(spark, d):
    return rank.candidate_images(image_questions(spark, d), image_hits(spark, d), image_rows(spark, d))


@query(
    f"WITH {IMAGES_CTE}, s AS (SELECT question_id, img_idx AS img_id, lower(text) AS q, lower(coalesce(caption, '')) AS c, CASE WHEN img_idx % 3 = 0 THEN 'a portrait of a woman' ELSE 'a bar chart' END AS description, (img_idx % 101) / 100 AS score FROM ih JOIN iq USING (question_id) JOIN im USING (doc_id, page)), "
    "v AS (SELECT *, CASE WHEN (contains(c, 'reviewer') AND contains(q, 'author') AND NOT contains(q, 'reviewer')) OR (contains(c, 'author') AND contains(q, 'reviewer') AND NOT contains(q, 'author')) THEN score * 0.3 ELSE score END AS sc FROM s), "
    f"f AS (SELECT DISTINCT question_id, img_id, sc FROM v WHERE (NOT {has('q', rank.PERSON_WORDS)} OR {has('description', rank.PORTRAIT_WORDS)}) AND sc >= CASE WHEN {has('q', rank.PERSON_THRESHOLD_WORDS)} THEN 0.25 ELSE 0.4 END) "
    "SELECT question_id, img_id, round(sc, 2) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sc DESC, img_id)::INT AS rank FROM f) WHERE rank <= 3"
)
def rank_images(spark, d):
    met = image_hits(spark, d).join(image_rows(spark, d), ["doc_id", "page"]).join(image_questions(spark, d).select("question_id", F.col("text").alias("question")), "question_id")
    description = F.when(F.col("img_idx") % 3 == 0, "a portrait of a woman").otherwise("a bar chart")
    rows = met.select("question_id", F.col("img_idx").alias("img_id"), "question", "caption", description.alias("description"), ((F.col("img_idx") % 101) / 100).alias("score")).distinct()
    return rank.rank_images(rows)
