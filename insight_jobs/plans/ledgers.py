"""Queries of the ledger operators over conversations, customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ledger
from ..operators.quantiles import exact_quantiles
from ..sources import io
from .registry import query, table


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), "role", F.col("text").alias("content"))


TURNS_SQL = "(SELECT conv_id, turn AS id, role, text AS content FROM conversations)"


@query(f"SELECT conv_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM {TURNS_SQL}) WHERE k <= 4")
def last_turns(spark, d):
    return ledger.last_turns(turns(spark, d), ["conv_id"], 2)


@query(f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' || content ELSE 'Assistant: ' || CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '…' ELSE content END END, chr(10) ORDER BY id) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM {TURNS_SQL} WHERE role IN ('user', 'assistant')) WHERE k <= 6 GROUP BY 1")
def history_prompt(spark, d):
    return ledger.history_prompt(turns(spark, d), ["conv_id"])


@query("SELECT * FROM (SELECT CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS user_id, conv_id, turn, unnest([0, 1])::INT AS part, unnest(['user', 'assistant']) AS role, unnest([prev, text]) AS content FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant') WHERE user_id IS NOT NULL")
def append_turns(spark, d):
    rows = table(spark, d, "conversations").withColumn("question", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return ledger.append_turns(rows.select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("user_id"), "conv_id", "turn", "question", F.col("text").alias("answer")))


def sessions(spark, d):
    start = F.expr("TIMESTAMP_NTZ'1993-01-01' + make_dt_interval(CAST(c_custkey % 1500 AS INT))")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("filename"), start.alias("created_at"), start.alias("updated_at"))


def history(spark, d):
    return table(spark, d, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.col("o_orderdate").alias("created_at"))


SESSIONS_SQL = "(SELECT c_custkey AS session_id, c_name AS filename, TIMESTAMP '1993-01-01' + to_days((c_custkey % 1500)::INT) AS created_at FROM customer)"
HISTORY_SQL = "(SELECT o_custkey AS session_id, o_orderkey AS id, o_orderpriority AS question, o_orderstatus AS answer, o_orderdate AS created_at FROM orders WHERE o_custkey % 7 <> 0)"


@query(f"SELECT session_id, filename, coalesce(n, 0) AS turns FROM {SESSIONS_SQL} LEFT JOIN (SELECT session_id, count(*) AS n FROM {HISTORY_SQL} GROUP BY 1) USING (session_id)")
def list_sessions(spark, d):
    return ledger.list_sessions(sessions(spark, d), history(spark, d)).select("session_id", "filename", "turns")


@query(f"SELECT h.session_id, h.id FROM {HISTORY_SQL} h JOIN {SESSIONS_SQL} s USING (session_id) WHERE h.created_at >= CASE WHEN session_id % 5 = 0 THEN TIMESTAMP '1996-01-01' ELSE s.created_at END")
def session_history(spark, d):
    since = sessions(spark, d).where("session_id % 5 = 0").select("session_id", F.lit("1996-01-01").cast("timestamp_ntz").alias("since"))
    return ledger.session_history(history(spark, d), sessions(spark, d), since).select("session_id", "id")


@query(f"WITH u AS (SELECT DISTINCT session_id, question, CASE WHEN session_id % 4 = 0 THEN ' ' ELSE 'new ' || question END AS answer FROM {HISTORY_SQL} WHERE session_id % 2 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY session_id, question ORDER BY id DESC) AS k FROM {HISTORY_SQL}) SELECT h.session_id, h.id, h.question, CASE WHEN k = 1 THEN coalesce(u.answer, h.answer) ELSE h.answer END AS answer FROM h LEFT JOIN u ON u.session_id = h.session_id AND u.question = h.question AND trim(u.answer) <> ''")
def update_last_answer(spark, d):
    updates = history(spark, d).where("session_id % 2 = 0").select("session_id", "question", F.when(F.col("session_id") % 4 == 0, " ").otherwise(F.concat(F.lit("new "), "question")).alias("answer")).distinct()
    return ledger.update_last_answer(history(spark, d), updates, ["session_id", "question"]).select("session_id", "id", "question", "answer")


@query(f"SELECT session_id, greatest(s.created_at, m) AS updated_at FROM {SESSIONS_SQL} s LEFT JOIN (SELECT session_id, max(created_at) AS m FROM {HISTORY_SQL} GROUP BY 1) USING (session_id)")
def touch_sessions(spark, d):
    return ledger.touch_sessions(sessions(spark, d), history(spark, d)).select("session_id", "updated_at")


def doc_sessions(spark, d):
    """Events as document sessions with JSON metadata."""
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"), F.col("props").alias("metadata"))


@query("SELECT user_id, event_id AS doc_id, ts AS created_at, json_extract_string(props, '$.k')::BIGINT AS text_chunks, CASE event_id % 3 WHEN 0 THEN 0 ELSE event_id % 7 END AS images_found, CASE event_id % 3 WHEN 2 THEN event_id % 5 ELSE 0 END AS tables_found FROM events")
def list_documents(spark, d):
    """Metadata with the newer names, the older ones, and without some."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    number = lambda n: (F.col("event_id") % n).cast("string")
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"text_chunks": '), k, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"text_count": '), k, F.lit(', "image_count": '), number(7), F.lit("}")))
    whole = F.concat(F.lit('{"text_chunks": '), k, F.lit(', "text_count": -1, "images_found": '), number(7), F.lit(', "tables_found": '), number(5), F.lit("}"))
    return ledger.list_documents(e.select("user_id", F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"), told.otherwise(whole).alias("metadata")))


@query("WITH s AS (SELECT user_id AS doc_id, props AS metadata, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id % 3 <> 0), c AS (SELECT c_custkey AS doc_id, '{\"name\": \"' || c_name || '\"}' AS metadata FROM customer) SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, coalesce(a.metadata, c.metadata) AS metadata, CASE WHEN a.metadata IS NOT NULL THEN 'session' ELSE 'cache' END AS origin FROM (SELECT * FROM s WHERE k = 1) a FULL JOIN c ON a.doc_id = c.doc_id")
def document_metadata(spark, d):
    s = table(spark, d, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("user_id"), F.col("ts").alias("created_at"), F.col("props").alias("metadata"))
    cache = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit('{"name": "'), "c_name", F.lit('"}')).alias("metadata"))
    return ledger.document_metadata(s, cache)


def feedback(spark, d):
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), rating.alias("rating"))


@query("SELECT event_id, user_id AS doc_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END::INT AS rating FROM events WHERE event_type IN ('purchase', 'error')")
def feedback_valid(spark, d):
    return ledger.feedback_valid(feedback(spark, d))


@query("SELECT user_id AS doc_id, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def feedback_rollup(spark, d):
    return ledger.feedback_rollup(feedback(spark, d), "doc_id")


@query("SELECT doc_id, id, round(list_avg(list_filter([f, p, r], lambda x: x IS NOT NULL)), 4) AS overall FROM (SELECT user_id AS doc_id, event_id AS id, value / 97 AS f, CASE WHEN event_id % 3 <> 0 THEN value / 203 END AS p, CASE WHEN event_id % 5 <> 0 THEN value / 151 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_eval(spark, d):
    value = F.col("value")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.col("ts").alias("evaluated_at"), (value / 97).alias("f"), F.when(F.col("event_id") % 3 != 0, value / 203).alias("p"), F.when(F.col("event_id") % 5 != 0, value / 151).alias("r"))
    return ledger.latest_eval(rows, "doc_id", ["f", "p", "r"], ["evaluated_at", "id"]).select("doc_id", "id", "overall")


@query("SELECT event_type AS category, count(*) FILTER (value > 50) AS passed, count(*) AS total, round(count(*) FILTER (value > 50) / count(*), 4) AS share FROM events GROUP BY ROLLUP (event_type)")
def eval_rollup(spark, d):
    return ledger.eval_rollup(table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("value") > 50).alias("passed")))


@query("WITH x AS (SELECT 0 AS check_id, avg(l_quantity) AS expected FROM lineitem UNION ALL SELECT 1, count(*) FILTER (l_quantity > 25)::DOUBLE FROM lineitem UNION ALL SELECT 2, median(l_extendedprice) FROM lineitem) SELECT check_id, round(expected, 4) AS expected, check_id <> 2 AS passed FROM x")
def run_table_checks(spark, d):
    line = table(spark, d, "lineitem")
    expected = line.agg(F.avg("l_quantity").alias("a"), F.count_if(F.col("l_quantity") > 25).cast("double").alias("b"))
    expected = expected.crossJoin(exact_quantiles(line, ["l_extendedprice"], [0.5]).select(F.col("value").alias("c")))  # one row each
    rows = expected.select(F.posexplode(F.array("a", "b", "c")).alias("check_id", "expected")).withColumn("tolerance", F.lit(0.1))
    said = rows.select("check_id", F.when(F.col("check_id") < 2, F.concat(F.lit("It is "), F.format_string("%.3f", "expected"), F.lit(" in all."))).otherwise("I do not know.").alias("text"))
    return ledger.run_table_checks(said, rows).select("check_id", F.round("expected", 4).alias("expected"), "passed")


@query("WITH d AS (SELECT lang AS doc_id, doc_id AS chunk_id, text FROM documents WHERE length(text) > 100), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM d) SELECT doc_id, chunk_id, substr(text, 1, 800) AS text FROM k WHERE k % greatest(1, n // 10) = 0 AND k // greatest(1, n // 10) < 10")
def sample_eval_chunks(spark, d):
    return ledger.sample_eval_chunks(table(spark, d, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text"), 10, ["chunk_id"])


VERDICTS_SQL = "(SELECT user_id AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS rank, CASE WHEN event_id % 9 <> 0 THEN (value > 60)::INT END AS relevant, CASE WHEN event_id % 11 <> 0 THEN (value > 30)::INT END AS attributed FROM events)"


def verdicts(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("question_id"), rank.alias("rank"), F.when(F.col("event_id") % 9 != 0, (F.col("value") > 60).cast("int")).alias("relevant"), F.when(F.col("event_id") % 11 != 0, (F.col("value") > 30).cast("int")).alias("attributed"))


@query(f"WITH v AS (SELECT *, sum(relevant) OVER (PARTITION BY question_id ORDER BY rank) AS h, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS s FROM {VERDICTS_SQL} WHERE relevant IS NOT NULL) SELECT question_id, round(coalesce(sum(h / s) FILTER (relevant = 1) / nullif(sum(relevant), 0), 0.0), 4) AS context_precision FROM v GROUP BY 1")
def context_precision(spark, d):
    return ledger.context_precision(verdicts(spark, d))


@query(f"SELECT question_id, round(avg(attributed), 4) AS context_recall FROM {VERDICTS_SQL} GROUP BY 1")
def context_recall(spark, d):
    return ledger.context_recall(verdicts(spark, d))


def halves(spark, d):
    """documents in two overlapping halves, the second with changed and blank texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.concat(F.lit("new "), "text"))
    return docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 <> 1").withColumn("text", changed)


@query("WITH a AS (SELECT doc_id, text, 0 AS v FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, substr('new ' || text, 1, 2000) AS text, 1 AS v FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 10 <> 0), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doc_id, text FROM u WHERE k = 1")
def upsert_nodes(spark, d):
    return io.upsert_nodes(*halves(spark, d), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_documents(spark, d):
    return io.new_documents(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', count(*) FROM labels WHERE toxic = 0")
def delete_keys(spark, d):
    tables = {"documents": table(spark, d, "documents"), "labels": table(spark, d, "labels")}
    left = io.delete_keys(tables, tables["labels"].where("toxic = 1"), {k: ["doc_id"] for k in tables})
    count = lambda k: left[k].agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("documents").union(count("labels"))
