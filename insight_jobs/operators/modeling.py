"""Feature preparation, model comparison and reports on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from .neighbours import neighbours
from .profile import categorical_columns, class_balance, id_like_columns, name, numeric_columns, value

SEED = 42


def split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the row's key: the same rows however they are partitioned."""
    test = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.where(~test), df.where(test)


def prepare_features(df: DataFrame, target: str | None, most: int | None = None, drop: list[str] = ()) -> tuple[DataFrame, Pipeline]:
    """Rows with `label`, and the pipeline that makes their `features`.

    Id-like columns go; text levels are numbered in alphabetical order, null being the level 'nan'; numeric nulls get the
    median, or 0 where a column has no value; all is standardised. most: train on a random sample of about so many rows.
    """
    if most:
        n = df.count()
        df = df.sample(min(1.0, most / n), seed=SEED) if n > most else df
    ids = {r["column"] for r in id_like_columns(df).select("column").collect()} | set(drop)  # names of columns
    text = [c for c in categorical_columns(df) if c != target and c not in ids]
    numbers = [c for c in numeric_columns(df) if c != target and c not in ids]
    levels = [F.coalesce(name(c).cast("string"), F.lit("nan")).alias(c) for c in text]
    label = []
    if target:
        kind = F.col(target) if target in numeric_columns(df) else F.coalesce(name(target).cast("string"), F.lit("nan"))
        label = [kind.alias("label_in")]
    filled = df.agg(*[F.count(value(c)).alias(str(i)) for i, c in enumerate(numbers)]).first() if numbers else []
    rows = df.select(*levels, *[(value(c) if filled[i] else F.lit(0.0)).alias(c) for i, c in enumerate(numbers)], *label)
    stages = [StringIndexer(inputCols=text, outputCols=[f"{c}__i" for c in text], stringOrderType="alphabetAsc", handleInvalid="keep")] if text else []
    stages += [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__f" for c in numbers])] if numbers else []
    stages += [VectorAssembler(inputCols=[*[f"{c}__f" for c in numbers], *[f"{c}__i" for c in text]], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    return rows, Pipeline(stages=stages)


def candidates(task: str, trees: int = 100, boosted: int = 50) -> dict:
    """Three models for a task, with fixed settings."""
    if task == "classification":
        return {"Random Forest": C.RandomForestClassifier(numTrees=trees, maxDepth=10, seed=SEED), "Logistic Regression": C.LogisticRegression(maxIter=1000), "Gradient Boosting": C.GBTClassifier(maxIter=boosted, maxDepth=4, seed=SEED)}
    if task == "regression":
        return {"Random Forest": R.RandomForestRegressor(numTrees=trees, maxDepth=10, seed=SEED), "Gradient Boosting": R.GBTRegressor(maxIter=boosted, maxDepth=4, seed=SEED), "Linear Regression": R.LinearRegression()}
    return {f"KMeans k={k}": K.KMeans(k=k, seed=SEED) for k in (3, 4, 5)}


def labelled(rows: DataFrame, task: str) -> DataFrame:
    if task == "clustering":
        return rows
    if task == "classification":
        indexer = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc")
        text = rows.where("label_in IS NOT NULL").withColumn("label_text", F.col("label_in").cast("string"))
        return indexer.fit(text).transform(text)
    return rows.where("label_in IS NOT NULL").withColumn("label", F.col("label_in").cast("double"))


def compare_models(df: DataFrame, target: str | None, task: str, folds: int = 3, models: dict | None = None, drop: list[str] = ()) -> tuple[DataFrame, dict]:
    """(results, fitted models): each model on a hold-out fifth; a failing model has a row with its reason.

    A fitted model holds its preparation, so that it takes raw rows and can be saved whole. Folds are fitted side by side.
    """
    spark = df.sparkSession
    rows, pipeline = prepare_features(df, target, drop=drop)
    train, test = split(labelled(rows, task), rows.columns) if task != "clustering" else (rows, rows)
    prepared = pipeline.fit(train)
    parts = spark.sparkContext.defaultParallelism  # a task a core
    fit_for = lambda rows: prepared.transform(rows).coalesce(parts).cache()
    train, test = fit_for(train), fit_for(test)
    out, fitted = [], {}
    for label, estimator in (models or candidates(task)).items():
        try:
            if task == "classification":
                if isinstance(estimator, C.GBTClassifier) and train.agg(F.count_distinct("label")).first()[0] > 2:
                    estimator = C.OneVsRest(classifier=estimator)
                model = estimator.fit(train)
                accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
                cv, spread = None, None
                if folds > 1:
                    crossed = CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=accuracy, numFolds=folds, seed=SEED, parallelism=folds).fit(train)
                    cv, spread = float(crossed.avgMetrics[0]), float(crossed.stdMetrics[0])
                out.append((label, accuracy.evaluate(model.transform(test)), cv, spread, None, None, None, None, None))
            elif task == "regression":
                model = estimator.fit(train)
                predicted = model.transform(test)
                out.append((label, None, None, None, RegressionEvaluator(metricName="r2").evaluate(predicted), RegressionEvaluator(metricName="rmse").evaluate(predicted), None, None, None))
            else:
                model = estimator.fit(train)
                out.append((label, None, None, None, None, None, model.summary.trainingCost, model.getK(), None))
            fitted[label] = PipelineModel(stages=[*prepared.stages, model])
        except Exception as e:
            out.append((label, *[None] * 7, str(e)[:200]))
    train.unpersist()
    test.unpersist()
    schema = "model string, test_accuracy double, cv_accuracy double, cv_deviation double, r2 double, rmse double, inertia double, n_clusters int, failure string"
    results = spark.createDataFrame(out, schema)
    metric = F.coalesce("test_accuracy", "r2", -F.col("inertia"))
    best = results.agg(F.max_by("model", F.when(metric.isNotNull(), F.struct(metric, F.col("model")))).alias("best"))
    shown = [F.round(c, 4).alias(c) for c in ("test_accuracy", "cv_accuracy", "cv_deviation", "r2", "rmse", "inertia")]
    return results.crossJoin(F.broadcast(best)).select("model", *shown, "n_clusters", "failure", (F.col("model") == F.col("best")).alias("best")), fitted  # one row


def train_one(df: DataFrame, target: str, algorithm: str, drop: list[str] = ()):
    """(results, models, report) of one named algorithm; report: of the hold-out rows, by class or over all."""
    named = {
        "random forest": ("classification", C.RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED)), "logistic": ("classification", C.LogisticRegression(maxIter=1000)),
        "naive bayes": ("classification", C.NaiveBayes(modelType="gaussian")), "svm": ("classification", C.LinearSVC()), "decision tree": ("classification", C.DecisionTreeClassifier(maxDepth=10, seed=SEED)),
        "gradient boosting": ("classification", C.GBTClassifier(maxIter=100, maxDepth=5, seed=SEED)), "kmeans": ("clustering", K.KMeans(k=3, seed=SEED)), "linear": ("regression", R.LinearRegression()),
    }
    task, estimator = named[algorithm]
    results, models = compare_models(df, None if task == "clustering" else target, task, models={algorithm: estimator}, drop=drop)
    if task == "clustering" or algorithm not in models:
        return results, models, None
    rows = labelled(prepare_features(df, target, drop=drop)[0], task)
    predicted = models[algorithm].transform(split(rows, rows.columns)[1])
    return results, models, classification_report(predicted) if task == "classification" else regression_report(predicted)


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support; rows 'accuracy', 'macro avg' and 'weighted avg' too."""
    m = confusion_matrix(predictions)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = m.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    called = m.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("called"))
    base = actual.join(called, "c", "full").select(F.col("c").cast("string").alias("class"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "tp", "called")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = base.withColumn("precision", zero(F.col("tp"), F.col("called"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    rates = rates.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = F.sum("support")
    acc = F.sum("tp") / total
    rows = [rates.select("class", "precision", "recall", "f1", "support"), rates.agg(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support"))]
    rows.append(rates.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")))
    rows.append(rates.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")))
    out = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return out.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def sweep(predictions: DataFrame, parts: int = 256) -> DataFrame:
    """score, p1, n1 (of this score), tp, fp, p, n: running counts from the highest score down.

    Rows are first counted by score; scores are cut at approximate quantiles into ranges, running sums over these give
    each range its start, and only the scores of one range are summed in order.
    """
    by = predictions.groupBy("score").agg(F.sum("label").alias("p1"), F.sum(1 - F.col("label")).alias("n1"))
    bounds = by.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000).alias("bounds"))
    placed = by.crossJoin(F.broadcast(bounds)).select("score", "p1", "n1", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("score"))), F.lit(0)).alias("part"))  # one row
    sums = placed.groupBy("part").agg(F.sum("p1").alias("p_part"), F.sum("n1").alias("n_part"))
    above, every = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = sums.select("part", *[F.coalesce(F.sum(f"{c}_part").over(above), F.lit(0)).alias(f"{c}_start") for c in ("p", "n")], *[F.sum(f"{c}_part").over(every).alias(c) for c in ("p", "n")])
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    met = placed.join(F.broadcast(starts), "part")  # a row a range
    return met.select("score", "p1", "n1", (F.col("p_start") + F.sum("p1").over(w)).alias("tp"), (F.col("n_start") + F.sum("n1").over(w)).alias("fp"), "p", "n")


def roc_curve(predictions: DataFrame) -> DataFrame:
    return sweep(predictions).select("score", F.round(F.try_divide("fp", "n"), 6).alias("fpr"), F.round(F.try_divide("tp", "p"), 6).alias("tpr"))


def pr_curve(predictions: DataFrame) -> DataFrame:
    return sweep(predictions).select("score", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", "p"), 6).alias("recall"))


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids: a score's width is its own false share."""
    area = F.try_divide("n1", "n") * (F.try_divide("tp", "p") + F.try_divide(F.col("tp") - F.col("p1"), "p")) / 2
    return sweep(predictions).agg(F.round(F.sum(area), 6).alias("auc"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(place.alias("bin")).agg(F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("label"), 4).alias("observed"), F.count(F.lit(1)).alias("n"))


def regression_report(predictions: DataFrame) -> DataFrame:
    error = F.col("label") - F.col("prediction")
    mse = F.avg(error * error)
    return predictions.agg(F.round(1 - F.try_divide(mse, F.var_pop("label")), 4).alias("r2"), F.round(F.sqrt(mse), 4).alias("rmse"), F.round(F.avg(error), 4).alias("mean_residual"))


def learning_curve(train: DataFrame, test: DataFrame, estimator, fractions=(0.1, 0.3, 1.0)) -> DataFrame:
    """fraction, accuracy: prepared rows (features, label), models on growing shares of the training rows."""
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = [(f, float(evaluator.evaluate(estimator.fit(train.sample(f, seed=SEED) if f < 1 else train).transform(test)))) for f in fractions]
    return train.sparkSession.createDataFrame(rows, "fraction double, accuracy double")


def feature_importance(spark, model, names: list[str], top: int = 15) -> DataFrame:
    """column, importance of a fitted model: tree importances, else absolute coefficients."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficientMatrix.toArray()).mean(0) if hasattr(model, "coefficientMatrix") else np.abs(model.coefficients.toArray())
    rows = sorted(zip(names, map(float, values), strict=False), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(rows, "column string, importance double")


def swapped(k: int):
    """For F.transform: the k-th value replaced by column o."""
    return lambda v, i: F.when(i == k, F.col("o")).otherwise(v)


def permutation_importance(model, test: DataFrame, names: list[str], repeats: int = 5, evaluator=None) -> DataFrame:
    """column, importance: mean loss of accuracy when one feature comes from another row, in a random order of rows."""
    evaluator = evaluator or MulticlassClassificationEvaluator(metricName="accuracy")
    rows = test.select("label", vector_to_array("features").alias("x")).withColumn("row", F.xxhash64("x", "label", F.monotonically_increasing_id()))
    from pyspark.ml.functions import array_to_vector

    base = evaluator.evaluate(model.transform(rows.select("label", array_to_vector("x").alias("features"))))
    out = []
    for k, column in enumerate(names):
        losses = []
        for r in range(repeats):
            order = Window.partitionBy(F.pmod(F.xxhash64("row", F.lit(r + 100)), F.lit(64))).orderBy(F.xxhash64("row", F.lit(r)))
            other = F.coalesce(F.lead(F.get("x", F.lit(k))).over(order), F.first(F.get("x", F.lit(k))).over(order))
            mixed = rows.withColumn("o", other).select("label", array_to_vector(F.transform("x", swapped(k))).alias("features"))
            losses.append(base - evaluator.evaluate(model.transform(mixed)))
        out.append((column, float(np.mean(losses))))
    return test.sparkSession.createDataFrame(out, "column string, importance double")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """class, n, weight: rows / (classes * rows of the class)."""
    counts = df.where(name(target).isNotNull()).groupBy(name(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(totals)).select("class", "n", F.round(F.col("all") / (F.col("k") * F.col("n")), 6).alias("weight"))  # one row


def smote(train: DataFrame, target: str, features: list[str], minority: object, copies: float, k: int = 5) -> DataFrame:
    """Synthetic minority rows: each lies between a row and one of its k nearest of the whole minority.

    copies: how many a row makes; of a broken number the rest is made by so large a share of the rows. Neighbours and places
    are drawn by a hash of the row's values. Rows with a missing feature make none; a row alone is copied as it is.
    """
    few = train.where(name(target) == F.lit(minority)).select(F.array(*[value(f) for f in features]).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    rows = shared.written(few.withColumn("id", F.monotonically_increasing_id()), shared.fresh_dir(train.sparkSession, "minority"))
    near = neighbours(rows, k).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda n: n["x"]).alias("near"))  # k each
    draw = lambda *salt: F.pmod(F.xxhash64("x", "id", *salt), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = int(copies)
    number = F.lit(whole) + F.when(draw(F.lit("more")) < copies - whole, 1).otherwise(0)
    made = rows.join(near, "id", "left").withColumn("n", number).where("n > 0").select("id", "x", "near", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    other = F.coalesce(F.get("near", F.floor(draw("copy", F.lit("other")) * F.size("near")).cast("int")), F.col("x"))
    placed = made.select(F.zip_with("x", other, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("xs"), draw("copy", F.lit("place")).alias("w"))
    return placed.select(*[(F.get("xs", F.lit(i))["a"] + F.col("w") * (F.get("xs", F.lit(i))["b"] - F.get("xs", F.lit(i))["a"])).alias(f) for i, f in enumerate(features)], F.lit(minority).alias(target))


def balanced_rows(train: DataFrame, target: str, features: list[str], k: int = 5) -> DataFrame:
    """The features, the target and `weight`: what the target's imbalance calls for.

    Balanced classes weigh 1. Mild imbalance is met by class weights; severe or extreme imbalance by synthetic rows of the
    smallest class up to the number of the largest, or by class weights where it has too few rows to make them from.
    """
    plain = train.where(name(target).isNotNull()).select(*[value(f).alias(f) for f in features], name(target).alias(target))
    severity = class_balance(train, target).first()["severity"]
    counts = [(r["class"], r["n"]) for r in class_weights(train, target).orderBy("n", "class").limit(1).collect()]
    most = class_weights(train, target).agg(F.max("n")).first()[0]
    if severity == "balanced" or not counts:
        return plain.withColumn("weight", F.lit(1.0))
    least, n = counts[0]
    if severity in ("severe", "extreme") and n > k:
        return plain.unionByName(smote(train, target, features, least, most / n - 1, k)).withColumn("weight", F.lit(1.0))
    weights = class_weights(train, target).select(F.col("class").alias("_class"), "weight")
    return plain.join(weights, F.col(target) == F.col("_class")).drop("_class")


def cluster(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """(rows with a label for the first k, costs by k)."""
    data = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data).persist()
    models = [K.KMeans(k=k, seed=SEED).fit(scaled) for k in ks]
    costs = df.sparkSession.createDataFrame([(k, float(m.summary.trainingCost)) for k, m in zip(ks, models, strict=True)], "k int, cost double")
    scaled.unpersist()
    return models[0].transform(scaled).drop("raw", "features").withColumnRenamed("prediction", "cluster"), costs


def recommendation_facts(questions: DataFrame, shape: DataFrame, predictors: DataFrame, balance: DataFrame) -> DataFrame:
    """Questions (with target and task) and their table's rows, columns, four best predictors and class balance; each side is one row."""
    best = predictors.orderBy(F.desc("abs_r"), "column").limit(4).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("abs_r")).alias("o"), "column"))), lambda x: x["column"]), ", ").alias("predictors"))
    facts = shape.select("n_rows", "n_columns").limit(1).crossJoin(best).crossJoin(balance.select("ratio", "severity"))
    return questions.crossJoin(F.broadcast(facts))


def scored(predictions: DataFrame, probability: Column) -> DataFrame:
    return predictions.withColumn("score", probability)
