"""Queries of the modelling operators; predictions come from a rule, so that reports have exact twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import correlate, modeling, neighbours, profile
from .registry import query, table
from .tables import PAIRS_SQL, lines, pairs
from .texts import QUESTIONS_SQL, has, questions


def predictions(spark, d):
    label = (F.col("l_returnflag") == "R").cast("int")
    return lines(spark, d).select(label.alias("label"), (F.col("l_quantity") > 25).cast("int").alias("prediction"), (F.col("l_quantity") / 50).alias("score"))


PRED_SQL = "(SELECT (l_returnflag = 'R')::INT AS label, (l_quantity > 25)::INT AS prediction, l_quantity / 50 AS score FROM lineitem)"


@query(f"SELECT label, prediction, count(*) AS n FROM {PRED_SQL} GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return modeling.confusion_matrix(predictions(spark, d))


@query(
    f"WITH p AS {PRED_SQL}, c AS (SELECT c.c, count(*) FILTER (label = c.c) AS support, count(*) FILTER (label = c.c AND prediction = c.c) AS tp, count(*) FILTER (prediction = c.c) AS called FROM p, (VALUES (0), (1)) c(c) GROUP BY 1), "
    "r AS (SELECT *, coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r) "
    "SELECT c::VARCHAR AS class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support::BIGINT AS support FROM f UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 4), round(sum(tp) / sum(support), 4), round(sum(tp) / sum(support), 4), sum(support)::BIGINT FROM f "
    "UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), sum(support)::BIGINT FROM f UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), sum(support)::BIGINT FROM f"
)
def classification_report(spark, d):
    return modeling.classification_report(predictions(spark, d))


SWEEP_SQL = f"(SELECT score, sum(a) OVER (ORDER BY score DESC) AS tp, sum(b) OVER (ORDER BY score DESC) AS fp, sum(a) OVER () AS p, sum(b) OVER () AS n FROM (SELECT score, sum(label) AS a, sum(1 - label) AS b FROM {PRED_SQL} GROUP BY 1))"


@query(f"SELECT score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM {SWEEP_SQL}")
def roc_curve(spark, d):
    return modeling.roc_curve(predictions(spark, d))


@query(f"SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM {SWEEP_SQL}")
def pr_curve(spark, d):
    return modeling.pr_curve(predictions(spark, d))


@query(f"WITH a AS (SELECT score, fp / n AS x, tp / p AS y FROM {SWEEP_SQL}) SELECT round(sum(t), 6) AS auc FROM (SELECT (x - coalesce(lag(x) OVER (ORDER BY score DESC), 0)) * (y + coalesce(lag(y) OVER (ORDER BY score DESC), 0)) / 2 AS t FROM a)")
def auc(spark, d):
    return modeling.auc(predictions(spark, d))


@query(f"SELECT least(floor(score * 10), 9)::INT AS bin, round(avg(score), 4) AS mean_score, round(avg(label), 4) AS observed, count(*) AS n FROM {PRED_SQL} GROUP BY 1")
def calibration(spark, d):
    return modeling.calibration(predictions(spark, d))


@query("SELECT round(1 - avg((l_extendedprice - p) * (l_extendedprice - p)) / var_pop(l_extendedprice), 4) AS r2, round(sqrt(avg((l_extendedprice - p) * (l_extendedprice - p))), 4) AS rmse, round(avg(l_extendedprice - p), 4) AS mean_residual FROM (SELECT l_extendedprice, l_quantity * 1500 AS p FROM lineitem)")
def regression_report(spark, d):
    return modeling.regression_report(lines(spark, d).select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))


@query("SELECT l_returnflag AS class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def class_weights(spark, d):
    return modeling.class_weights(lines(spark, d), "l_returnflag")


def sample_table(spark, d):
    """Document labels with two features of the text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", (F.length("text") - F.length(F.translate("text", "#*$%&|", ""))).alias("n_symbols"))
    return docs.join(table(spark, d, "labels"), "doc_id")


@query()
def compare_models(spark, d):
    return modeling.compare_models(sample_table(spark, d), "quality", "classification", drop=["doc_id"])[0]


@query()
def train_one(spark, d):
    return modeling.train_one(sample_table(spark, d), "quality", "decision tree", drop=["doc_id"])[0]


@query()
def train_report(spark, d):
    return modeling.train_one(sample_table(spark, d), "quality", "decision tree", drop=["doc_id"])[2]


@query()
def learning_curve(spark, d):
    from pyspark.ml import classification as C

    rows, pipeline = modeling.prepare_features(sample_table(spark, d), "quality", drop=["doc_id"])
    train, test = modeling.split(modeling.labelled(rows, "classification"), rows.columns)
    prepared = pipeline.fit(train)
    return modeling.learning_curve(prepared.transform(train), prepared.transform(test), C.DecisionTreeClassifier(maxDepth=10, seed=modeling.SEED))


@query()
def permutation_importance(spark, d):
    from pyspark.ml import classification as C

    rows, pipeline = modeling.prepare_features(sample_table(spark, d), "quality", drop=["doc_id"])
    train, test = modeling.split(modeling.labelled(rows, "classification"), rows.columns)
    prepared = pipeline.fit(train)
    model = C.DecisionTreeClassifier(maxDepth=10, seed=modeling.SEED).fit(prepared.transform(train))
    return modeling.permutation_importance(model, prepared.transform(test), [*[c for c in ("n_chars", "n_symbols", "toxic") if c in rows.columns], "lang"])


@query()
def cluster_costs(spark, d):
    return modeling.cluster(sample_table(spark, d), ["n_chars", "n_symbols"])[1]


@query()
def cluster(spark, d):
    return modeling.cluster(sample_table(spark, d), ["n_chars", "n_symbols"])[0].select("doc_id", "cluster")


@query()
def smote(spark, d):
    return modeling.smote(sample_table(spark, d), "toxic", ["n_chars", "n_symbols"], 1, 2)


@query("SELECT id, other, round(away, 6) AS away, rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS away, row_number() OVER (PARTITION BY a.vec_id ORDER BY away, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5")
def nearest_rows(spark, d):
    """Exact neighbours of all vectors by distance."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return neighbours.neighbours(rows, 5, vectors=False).select("id", "other", F.round("away", 6).alias("away"), "rank")


@query()
def feature_importance(spark, d):
    rows, pipeline = modeling.prepare_features(sample_table(spark, d), "quality", drop=["doc_id"])
    data = modeling.labelled(rows, "classification")
    prepared = pipeline.fit(data).transform(data)
    from pyspark.ml import classification as C

    model = C.RandomForestClassifier(numTrees=20, maxDepth=10, seed=modeling.SEED).fit(prepared)
    names = [*[c for c in ("n_chars", "n_symbols", "toxic") if c in rows.columns], "lang"]
    return modeling.feature_importance(spark, model, names)


@query(
    f"WITH b AS (SELECT count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag), r AS (SELECT min(n) / (SELECT count(*) FROM lineitem) AS r FROM b), "
    f"t AS (SELECT CASE WHEN col1 = 'l_extendedprice' THEN col2 ELSE col1 END AS c, abs(r) AS a FROM ({PAIRS_SQL}) WHERE (col1 = 'l_extendedprice' OR col2 = 'l_extendedprice') AND r IS NOT NULL ORDER BY a DESC, c LIMIT 4) "
    f"SELECT question_id, 'l_extendedprice' AS target, CASE WHEN {has('lower(text)', rules.CLUSTERING_WORDS)} THEN 'clustering' WHEN {has('lower(text)', rules.REGRESSION_WORDS)} THEN 'regression' WHEN {has('lower(text)', rules.CLASSIFICATION_WORDS)} THEN 'classification' ELSE 'regression' END AS task, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM lineitem)) AS n_columns, (SELECT string_agg(c, ', ' ORDER BY a DESC, c) FROM t) AS predictors, round(r, 3) AS ratio, "
    f"CASE WHEN r < 0.05 THEN 'extreme' WHEN r < 0.2 THEN 'severe' WHEN r < 0.4 THEN 'mild' ELSE 'balanced' END AS severity FROM {QUESTIONS_SQL}, r"
)
def recommendation_facts(spark, d):
    shape = profile.table_shape(lines(spark, d))
    asked = questions(spark, d).withColumns({"target": F.lit("l_extendedprice"), "kind": F.lit("number"), "values": F.lit(1000)})
    tasks = rules.detect_task(asked, kind="kind", n_unique="values").select("question_id", "target", "task")
    return modeling.recommendation_facts(tasks, shape, correlate.target_correlation(pairs(spark, d), "l_extendedprice"), profile.class_balance(lines(spark, d), "l_returnflag"))
