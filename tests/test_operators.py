"""Small fixtures for what the driver's tables don't hold: nulls, constants, ties, empty texts, layouts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_jobs.functions import rules
from insight_jobs.operators import charts, chunks, correlate, filters, ground, ledger, modeling, profile, rank, retrieve
from insight_jobs.sources import io


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", 1.0, 2.0, 5.0, 0), (2, "a", 2.0, None, 5.0, 1), (3, "b", float("nan"), 6.0, 5.0, 1), (4, None, 4.0, 8.0, 5.0, 1), (4, None, 4.0, 8.0, 5.0, 1)]
    return spark.createDataFrame(rows, "id long, g string, x double, y double, k double, flag int")


def one(df):
    return df.collect()[0]


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_nulls_and_duplicates(small):
    nulls = by(profile.null_counts(small), "column", "n_nulls")
    assert (nulls["x"], nulls["y"], nulls["g"], nulls["id"]) == (1, 1, 2, 0)
    assert one(profile.duplicate_rows(small))["n_duplicates"] == 1


def test_constant_column(small):
    assert by(profile.column_stats(small), "column", "skew")["k"] == 0.0
    pairs = {(r["col1"], r["col2"]): r["r"] for r in correlate.correlation_pairs(small, ["x", "y", "k"]).collect()}
    assert pairs["x", "y"] == 1.0 and pairs["x", "k"] is None
    assert [r["column"] for r in correlate.low_variance_columns(small).collect()] == ["k"]
    assert charts.histogram(small, "k").count() == 1


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "g string")
    assert one(profile.categorical_summary(df))["mode"] == "a"


def test_class_balance_counts_nulls_in_all_rows(small):
    r = one(profile.class_balance(small, "g"))
    assert (r["n_classes"], r["minority"], r["n_rows"], r["severity"]) == (2, 1, 5, "mild")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert one(profile.duplicate_rows(empty))["n_duplicates"] == 0
    assert profile.value_counts(empty).count() == 0
    assert charts.histogram(empty, "a").count() == 0


def test_filters(small):
    assert filters.filter_any_null(small).count() == 4
    assert [r["id"] for r in filters.top_n(small, "x", 2, ["id"]).collect()] == [4, 4]
    with pytest.raises(ValueError):
        filters.select_columns(small, "^none$")


def test_parse_filter_falls_through_to_the_next_rule(spark):
    q = spark.createDataFrame([(1, "where Age is 5"), (2, "where zip is 5 and age > 3"), (3, "top 4 by Age"), (4, "empty cells"), (5, "hello")], "question_id long, text string")
    got = {r["question_id"]: (r["op"], r["column"], r["value"]) for r in filters.parse_filter(q, ["Age"]).collect()}
    assert got == {1: ("eq", "Age", "5"), 2: ("gt", "Age", "3"), 3: ("top_n", "Age", "4"), 4: ("any_null", None, None), 5: (None, None, None)}


def test_windows_hold_every_word(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    df = spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, "one")], "doc_id long, page int, text string")
    out = chunks.chunk_windows(df, 128, 16).orderBy("doc_id", "chunk").collect()
    words = []
    for r in out:
        if r["doc_id"] == 1:
            w = r["text"].split()
            words += w if not words else w[16:]
    assert words == text.split()
    assert [r["text"] for r in out if r["doc_id"] == 3] == ["one"]
    assert not [r for r in out if r["doc_id"] == 2]


def test_pack_sentences():
    assert chunks.pack_sentences("A b c. D e f. G h i.", 6, 3) == ["A b c. D e f.", "D e f. G h i."]
    assert chunks.pack_sentences("", 6, 3) == []


def test_captions_by_place(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 100.0, 100.0, 200.0, 200.0)], "doc_id long, page int, img_id long, x0 double, y0 double, x1 double, y1 double")
    texts = [(1, 1, 1, 100.0, 260.0, 200.0, 280.0, "below by sixty"), (1, 1, 2, 100.0, 40.0, 200.0, 60.0, "above by forty"), (1, 1, 3, 350.0, 100.0, 450.0, 150.0, "beside it, right"), (1, 1, 4, 100.0, 205.0, 200.0, 210.0, "short")]
    df = spark.createDataFrame(texts, "doc_id long, page int, block_id long, x0 double, y0 double, x1 double, y1 double, text string")
    r = one(chunks.attach_captions(boxes, df))
    assert (r["caption"], r["context"]) == ("below by sixty", "beside it, right")
    assert one(chunks.attach_captions(boxes, df.where("block_id > 1")))["caption"] == "above by forty"
    assert one(chunks.attach_captions(boxes, df.where("block_id = 9")))["caption"] is None


def test_unique_images_marks_a_hash_before_the_extension(spark):
    rows = [("d", 1, 1, "a.svg", "svg", b"x" * 10), ("d", 2, 1, "b.png", "png", b"x" * 10), ("d", 3, 1, "c.png", "png", b"y" * 10), ("d", 3, 2, "e.png", "png", b"y")]
    df = spark.createDataFrame(rows, "doc_id string, page int, img_idx int, filename string, ext string, bytes binary")
    assert [r["filename"] for r in chunks.unique_images(df, 5).collect()] == ["c.png"]


def test_questions(spark):
    df = spark.createDataFrame([("Compare A and B",), ("Who wrote it?",), ("xyzzy",), ("hello!",)], "text string")
    assert [r[0] for r in df.select(rules.classify_query(F.col("text"))).collect()] == ["COMPARATIVE", "FACTOID", "ANALYTICAL", "CONVERSATIONAL"]


def test_numbers(spark):
    df = spark.createDataFrame([(3.0,), (1234567.5,), (123.456,), (0.12345,), (None,)], "v double")
    assert [r[0] for r in df.select(rules.format_number(F.col("v"))).collect()] == ["3", "1.23e+06", "123.5", "0.123", ""]
    cases = {1e-12: "1e-12", 0.00001234: "1.23e-05", 0.0001: "0.0001", 0.00012345: "0.000123", 9.9996e-5: "0.0001", 99.96: "100", 100.25: "100.2", 100.35: "100.3", -0.5: "-0.5", 0.0: "0", 1e9: "1.00e+09", -1234567.8: "-1.23e+06", 12.345: "12.3"}
    rows = spark.createDataFrame([(v,) for v in cases], "v double").select("v", rules.format_number(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == cases


def test_sentences_and_support(spark):
    text = "Dr. Smith met the whole team of people today. Short one. The team of people went home quite late again!"
    df = spark.createDataFrame([(1, text, "smith met team people today whole"), (2, "", "x")], "answer_id long, text string, context string")
    got = [(r["sentence"][:8], r["label"]) for r in ground.sentence_support(df).orderBy("position").collect()]
    assert got == [("Dr. Smit", "supported"), ("The team", "uncertain")]
    assert by(ground.faithfulness(df), "answer_id", "label")[2] == "faithful"


def test_gate(spark):
    df = spark.createDataFrame([(1, 0.2, "low_similarity", "CAUSAL"), (2, 0.5, "borderline", "CAUSAL"), (3, 0.5, "borderline", "FACTOID"), (4, 1.0, "always_answer", "CAUSAL")], "question_id long, confidence double, reason string, query_class string")
    got = {r["question_id"]: (r["should_answer"], r["warning"] is not None, r["fallback"] is not None) for r in ground.gate(df).collect()}
    assert got == {1: (False, False, True), 2: (True, True, False), 3: (True, False, False), 4: (True, False, False)}


def test_rrf_of_equal_lanes_keeps_their_order(spark):
    lane = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "question_id long, chunk_id string, rank int")
    assert [r["chunk_id"] for r in retrieve.rrf_merge([lane, lane], 3).orderBy("rank").collect()] == ["a", "b", "c"]


def adaptive_by_rounds(kind, budget, dense, keyword, texts, score):
    """The three rounds one by one, in plain Python."""

    def merged(k):
        total, first = {}, {}
        for lane, hits in enumerate((dense, keyword)):
            for rank_, c in enumerate(hits[:k], 1):
                total[c] = total.get(c, 0) + 1 / (60 + rank_)
                first.setdefault(c, (lane, rank_))
        ranked = sorted(total, key=lambda c: (-round(total[c], 12), first[c], c))[:k]
        seen, out = set(), []
        for c in ranked:
            if (p := texts[c][:80].lower().strip()) not in seen:
                seen.add(p)
                out.append(c)
        return out

    hits = merged(budget[0])
    if kind in ("analytical", "summary") or score(hits) < 0.5:
        hits = merged(budget[1])
        if kind in ("analytical", "summary") and score(hits) < 0.5:
            hits = merged(budget[2])
    return hits


@pytest.mark.parametrize("base", [0.1, 0.45, 0.9])
def test_adaptive_retrieval_is_the_three_rounds(spark, base):
    texts = {c: f"text {c % 9} of apples" if c % 2 else f"Text {c} with pears" for c in range(30)}
    dense, keyword = list(range(0, 28, 2))[:14], list(range(1, 29, 2))[:14]
    kinds = ["factoid", "general", "analytical", "summary"]
    q = rules.retrieval_budget(spark.createDataFrame([(k, "apples pears plums", t) for k, t in enumerate(kinds)], "question_id long, text string, query_type string"))
    lane = lambda hits: spark.createDataFrame([(k, c, r, base) for k in range(4) for r, c in enumerate(hits, 1)], "question_id long, chunk_id long, rank int, score double")
    got = retrieve.adaptive_retrieve(q, lane(dense), lane(keyword), spark.createDataFrame(list(texts.items()), "chunk_id long, text string")).collect()

    def score(hits):
        found = set(" ".join(texts[c] for c in hits[:3]).lower().split())
        return round(0.65 * base + 0.35 * len({"apples", "pears", "plums"} & found) / 3, 3)

    for k, kind in enumerate(kinds):
        mine = [r["chunk_id"] for r in sorted((r for r in got if r["question_id"] == k), key=lambda r: r["pos"])]
        assert mine == adaptive_by_rounds(kind, rules.BUDGETS[kind], dense, keyword, texts, score)


def test_adaptive_retrieval_of_ids_with_slashes(spark):
    q = rules.retrieval_budget(spark.createDataFrame([("doc/1", "apples pears", "factoid"), ("doc/2/x", "apples pears", "summary")], "question_id string, text string, query_type string"))
    lane = spark.createDataFrame([(d, f"c{k}", k, 0.4) for d in ("doc/1", "doc/2/x") for k in range(1, 15)], "question_id string, chunk_id string, rank int, score double")
    texts = spark.createDataFrame([(f"c{k}", f"{k} plums") for k in range(1, 15)], "chunk_id string, text string")
    got = retrieve.adaptive_retrieve(q, lane, lane.limit(0), texts).collect()
    assert {(r["question_id"], r["round"], r["log"]) for r in got} == {
        ("doc/1", 1, "type=factoid budget=(3,4,4) | round1_k=3 conf=0.260 | round2_k=4 conf=0.260"),
        ("doc/2/x", 2, "type=summary budget=(6,10,14) | round1_k=6 conf=0.260 | round2_k=10 conf=0.260 | round3_k=14 conf=0.260"),
    }
    assert sum(r["question_id"] == "doc/1" for r in got) == 4


def test_captions_in_one_line(spark):
    boxes = spark.createDataFrame([(1, 1, "i", 0.0, 0.0, 100.0, 100.0), (1, 2, "j", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page int, img_id string, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 110.0, 100.0, 120.0, "About the author"), (1, 1, 2, 120.0, 0.0, 200.0, 90.0, "beside it stands more")], "doc_id long, page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r["img_id"]: r for r in chunks.attach_captions(boxes, blocks).collect()}
    assert got["i"]["combined"] == "Page heading: About the author | Caption/bio: About the author | Nearby text: beside it stands more"
    assert got["j"]["combined"] is None


def test_precision_cutoff(spark):
    rows = [(1, c, s) for c, s in zip("abcdef", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4), strict=True)] + [(2, "a", 0.1), (2, "b", 0.2), (2, "c", 0.3)]
    got = rank.precision_cutoff(spark.createDataFrame(rows, "question_id long, chunk_id string, score double")).collect()
    assert sorted(r["chunk_id"] for r in got if r["question_id"] == 1) == ["a", "b", "c", "d"]
    assert sum(r["question_id"] == 2 for r in got) == 3


def test_missing_parent_keeps_the_child(spark):
    hits = spark.createDataFrame([(1, "d", "c1", "p1", 1, 0.5, "child one"), (1, "d", "c2", "p1", 2, 0.4, "child two"), (1, "d", "c3", None, 3, 0.3, "alone")], "question_id long, doc_id string, chunk_id string, parent_id string, pos int, score double, text string")
    parents = spark.createDataFrame([("d", "p1", "the parent")], "doc_id string, parent_id string, text string")
    assert [r["text"] for r in retrieve.expand_to_parents(hits, parents).orderBy("pos").collect()] == ["the parent", "alone"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "c"), (3, " ")], "doc_id long, text string")
    once = io.upsert_nodes(old, new, ["doc_id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, io.upsert_nodes(once, new, ["doc_id"]).collect())) == [(1, "a"), (2, "c")]


def test_read_table_types_and_missing_marks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b c,d\n1,"x, ""y""",2.5\nNA,null,NaN\n3,z,\n')
    df = io.read_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "bigint"), ("b c", "string"), ("d", "double")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 'x, "y"', 2.5), (None, None, None), (3, "z", None)], key=str)
    path = io.write_table(df, str(tmp_path), "id", "original", "20200101")
    assert spark.read.csv(path, header=True).count() == 3


def test_binary_docs_over_the_limit_are_set_aside(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"1")
    kept, rejected = io.read_binary_docs(spark, str(tmp_path), 3)
    assert (kept.count(), rejected.count()) == (1, 1)
    pages = io.extract_pages(kept, lambda frames: (f.assign(page=1, text="t", method="m")[["doc_id", "page", "text", "method"]] for f in frames))
    assert one(pages)["text"] == "t"


def test_models(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 17).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).cast("double").alias("z"), F.when(F.col("id") % 17 > 8, "yes").otherwise("no").alias("y"))
    results, fitted = modeling.compare_models(df, "y", "classification", folds=1, models={k: v for k, v in modeling.candidates("classification", 5, 3).items() if k != "Gradient Boosting"})
    got = {r["model"]: r for r in results.collect()}
    assert got["Random Forest"]["test_accuracy"] > 0.9 and sum(r["best"] for r in got.values()) == 1
    assert io.load_model.__name__ and fitted
    reg, _ = modeling.compare_models(df, "x", "regression", models={"Linear Regression": modeling.candidates("regression")["Linear Regression"]})
    assert one(reg)["r2"] is not None
    clusters, _ = modeling.compare_models(df.drop("y"), None, "clustering")
    assert clusters.where("failure IS NULL").count() == 3
    rows, pipeline = modeling.prepare_features(df, "y")
    data = modeling.labelled(rows, "classification")
    prepared = pipeline.fit(data).transform(data)
    top = modeling.permutation_importance(fitted["Random Forest"].stages[-1], prepared, ["x", "z"], 1).orderBy(F.desc("importance")).first()
    assert top["column"] == "x"
    curve = modeling.learning_curve(prepared, prepared, modeling.candidates("classification", 5)["Random Forest"], (0.5, 1.0))
    assert curve.count() == 2
    path = io.save_model(pipeline.fit(data), str(tmp_path), "My Model")
    assert path.endswith("my_model_best") and io.load_model(path).transform(data).count() == 400
    whole = io.save_model(fitted["Random Forest"], str(tmp_path), "Random Forest")
    raw = data.select("x", "z", "label")
    assert io.load_model(whole).transform(raw).where("prediction = label").count() > 360


def test_a_column_without_values_counts_as_zero(spark):
    df = spark.range(300).select((F.col("id") % 97).alias("x"), F.lit(None).cast("double").alias("e"), F.when(F.col("id") % 97 > 50, "b").otherwise("a").alias("y"))
    results, models, report = modeling.train_one(df, "y", "decision tree")
    r = one(results)
    assert r["failure"] is None and r["test_accuracy"] > 0.9 and r["cv_accuracy"] > 0.9 and r["cv_deviation"] is not None
    assert {x["class"] for x in report.collect()} >= {"accuracy", "macro avg", "weighted avg", "0.0", "1.0"}
    assert models["decision tree"].transform(modeling.prepare_features(df, "y")[0]).count() == 300


def test_sweep_of_many_scores_by_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 2000), np.round(rng.random(2000), 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    got = {r["score"]: (r["tp"], r["fp"], r["p"], r["n"]) for r in modeling.sweep(df, 16).collect()}
    assert got == {b: (int(y[s >= b].sum()), int((1 - y)[s >= b].sum()), int(y.sum()), int((1 - y).sum())) for b in set(s.tolist())}
    pairs = (s[y == 1][:, None] > s[y == 0]).sum() + (s[y == 1][:, None] == s[y == 0]).sum() / 2
    assert one(modeling.auc(df))["auc"] == pytest.approx(pairs / (y.sum() * (1 - y).sum()), abs=1e-6)


def test_dense_search_keeps_large_ids(spark):
    big = 2**60
    vectors = spark.createDataFrame([(big + k, [1.0, float(k)]) for k in range(5)], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(big + 7, [1.0, 0.0])], "question_id long, embedding array<double>")
    assert [(r["question_id"], r["chunk_id"]) for r in retrieve.dense_topk(questions, vectors, 2).orderBy("rank").collect()] == [(big + 7, big), (big + 7, big + 1)]


def test_smote_lies_between_rows(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 1) for k in range(6)] + [(9.0, 9.0, 0)] * 20, "a double, b double, y int")
    made = modeling.smote(df, "y", ["a", "b"], 1, 2).collect()
    assert len(made) == 12 and all(abs(r["b"] - 2 * r["a"]) < 1e-9 and 0 <= r["a"] <= 5 for r in made)


def test_ledger_edges(spark):
    fb = spark.createDataFrame([(1, 1), (1, -1), (1, 0), (2, None)], "doc_id long, rating int")
    assert [tuple(r) for r in ledger.feedback_rollup(fb, "doc_id").collect()] == [(1, 1, 1)]
    v = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, None), (2, 1, 0)], "question_id long, rank int, relevant int")
    assert by(ledger.context_precision(v), "question_id", "context_precision") == {1: 0.5, 2: 0.0}


def test_lsh_finds_the_true_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    questions = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    exact = retrieve.dense_topk(questions, vectors, 10)
    got = retrieve.dense_topk_lsh(questions, vectors, 10).cache()
    assert got.count() == exact.count() == 10 * questions.count()
    assert got.join(exact, ["question_id", "chunk_id"], "left_semi").count() >= 0.9 * exact.count()


def test_lsh_answers_questions_without_shared_buckets(spark):
    vectors = spark.createDataFrame([(k, [1.0, 0.02 * k, 0.0]) for k in range(6)], "chunk_id long, embedding array<float>")
    questions = spark.createDataFrame([(1, [-1.0, 0.0, 0.1])], "question_id long, embedding array<float>")
    got = [(r["chunk_id"], r["rank"]) for r in retrieve.dense_topk_lsh(questions, vectors, 3, bucket=0.01).orderBy("rank").collect()]
    assert got == [(5, 1), (4, 2), (3, 3)]


def test_approximate_quantiles_lie_at_their_ranks(spark):
    df = spark.range(20_001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("g"))
    for exact in (True, False):
        q = profile.numeric_summary(df, exact=exact).first()
        assert [round(q[c], -1) for c in ("q25", "q50", "q75")] == [5000, 10_000, 15_000]
        assert round(profile.column_stats(df, exact=exact).first()["median"], -1) == 10_000
        assert round(profile.stat_profile(df, exact=exact).where("metric = 'median'").first()["value"], -1) == 10_000
        boxes = charts.box_stats(df, "x", "g", exact=exact).collect()
        assert len(boxes) == 2 and all(round(b["median"], -1) == 10_000 and b["n_outliers"] == 0 for b in boxes)
    assert profile.numeric_summary(df.where("false"), exact=False).first()["q50"] is None


@pytest.mark.parametrize("make", [lambda df: profile.numeric_summary(df), lambda df: profile.column_stats(df), lambda df: profile.stat_profile(df), lambda df: charts.box_stats(df, "x", "g")])
def test_exact_quartiles_hold_no_distinct_values(spark, make):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("g"))
    assert "percentile(" not in make(df)._jdf.queryExecution().optimizedPlan().toString()


def test_exact_quartiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), 7.0), (None, 1.0, 7.0), (None, 4.0, 7.0)], "`a.b` double, x double, c double")
    got = {r["column"]: (r["count"], r["q25"], r["q50"], r["q75"]) for r in profile.numeric_summary(df).collect()}
    assert got == {"a.b": (0, None, None, None), "x": (2, 1.75, 2.5, 3.25), "c": (3, 7.0, 7.0, 7.0)}
    assert profile.numeric_summary(df.where("false")).count() == 3 and profile.numeric_summary(df.select(F.lit("t").alias("t"))).count() == 0


def test_sampled_chunks_are_placed_by_keys(spark):
    rows = [("a", k // 2, f"{k:04d}" + "x" * (900 if k % 3 else 50)) for k in range(400)] + [(None, k, f"{k:04d}" + "y" * 200) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id long, text string")
    got = ledger.sample_eval_chunks(df, 10, ["chunk_id"], parts=5).collect()
    for doc in ("a", None):
        keys = sorted(c for d, c, t in rows if d == doc and len(t) > 100)
        step = max(1, len(keys) // 10)
        mine = [r for r in got if r["doc_id"] == doc]
        assert sorted(r["chunk_id"] for r in mine) == keys[::step][:10] and len({r["text"][:4] for r in mine}) == 10
        assert {(r["chunk_id"], r["text"]) for r in mine} <= {(c, t[:800]) for d, c, t in rows if d == doc}
    plan = ledger.sample_eval_chunks(df, 10, ["chunk_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.splitlines() if "Window" in w and "windowspecdefinition(doc_id#" in w and "text#" in w and "chunk_id" not in w.split("windowspecdefinition(")[1].split("ASC")[0]]


def test_lsh_makes_no_rows_of_pairs(spark):
    """What leaves a bucket is k rows a question, however many vectors share it."""
    vectors = spark.createDataFrame([(i, [1.0, 0.001 * (i % 7), 0.0]) for i in range(400)], "chunk_id long, embedding array<float>")
    questions = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    got = retrieve.dense_topk_lsh(questions, vectors, 3)
    assert by(got.where("question_id = 20").select("rank", "chunk_id"), "rank", "chunk_id") == {1: 6, 2: 13, 3: 20}
    seen = []
    whole, retrieve.top = retrieve.top, lambda df, *a: seen.append(df.count()) or whole(df, *a)
    try:
        retrieve.dense_topk_lsh(questions, vectors, 3)
    finally:
        retrieve.top = whole
    assert seen and max(seen) <= 2 * 3 * questions.count()


def test_a_negative_correlation_that_rounds_to_zero_keeps_its_sign(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=5000), rng.normal(size=5000)
    y -= x * (x @ y) / (x @ x) + 0.0003 * x
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    pairs = correlate.correlation_pairs(df)
    assert "y (r=-0.000)" in correlate.correlation_digest(pairs, correlate.low_variance_columns(df), "x").first()[0]


@pytest.mark.parametrize("part_rows", [50_000, 90])
def test_captions_of_one_page_need_no_pairs(spark, sf_dir, part_rows):
    """Large pages, whole or in parts, against DuckDB over all pairs; no join of images with texts is left in the plan."""
    import duckdb

    from insight_jobs import plans
    from insight_jobs.plans import docs

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (l_orderkey * 997 AS l_orderkey, l_suppkey * 5 + l_suppkey % 2 AS l_suppkey) FROM '{sf_dir}/lineitem.parquet' WHERE l_orderkey < 1500")
    got = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 1500").withColumn("l_orderkey", F.col("l_orderkey") * 997).withColumn("l_suppkey", F.col("l_suppkey") * 5 + F.col("l_suppkey") % 2)
    whole, docs.table = docs.table, lambda *_: got
    try:
        images, texts = docs.boxes(spark, sf_dir)
    finally:
        docs.table = whole
    out = chunks.attach_captions(images, texts, part_rows)
    wanted = con.execute(plans.oracle_sql()["attach_captions"]).fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, wanted)) and len(wanted) > 300
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 or part_rows < 1000  # with the lines of pages alone


def test_keyword_scores_are_added_where_a_chunk_is(spark):
    """A word of every chunk and question doesn't gather its postings: after the chunks are dealt only the best are shuffled."""
    chunk_rows = spark.createDataFrame([(i, f"common w{i % 7} w{i % 5}") for i in range(300)], "chunk_id long, text string").select(F.lit("all").alias("scope"), "chunk_id", "text")
    asked = spark.createDataFrame([(q, f"common w{q}") for q in range(6)], "question_id long, text string").select("question_id", F.lit("all").alias("scope"), "text")
    got = retrieve.bm25_topk(asked, chunk_rows, 4, keep_zero=True)
    assert got.count() == 24
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "SortMergeJoin" not in plan


def keyword_table(spark, n):
    """Chunks whose reading an accumulator counts, and questions."""
    read = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            read.add(len(b))
            yield b.assign(scope="all", chunk_id=b["id"], text=[f"apples w{i} w{i % 7} pears" for i in b["id"]])[["scope", "chunk_id", "text"]]

    asked = spark.createDataFrame([(1, "all", "apples w3"), (2, "all", "w5 w11 w11")], "question_id long, scope string, text string")
    return asked, spark.range(n).mapInPandas(made, "scope string, chunk_id long, text string"), read


def test_keyword_lane_reads_texts_once_for_counts(spark):
    asked, chunk_rows, read = keyword_table(spark, 40)
    got = retrieve.bm25_topk(asked, chunk_rows, 3)
    assert read.value == 40  # the words are counted, and nothing else yet
    assert [r["chunk_id"] for r in got.where("question_id = 2").orderBy("rank").collect()] == [11, 5, 12]
    assert read.value == 80


def test_keyword_lane_has_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "CHUNK_PARTS", 2)
    monkeypatch.setattr(retrieve, "PART_CHUNKS", 8, raising=False)
    asked, chunk_rows, _ = keyword_table(spark, 40)
    wanted = [(r["question_id"], r["chunk_id"], r["rank"]) for r in retrieve.bm25_topk(asked, chunk_rows, 3).orderBy("question_id", "rank").collect()]
    found = retrieve.bm25_topk(asked, chunk_rows, 3)
    assert "hashpartitioning(chunk_id#" in (plan := found._jdf.queryExecution().toString()) and ", 5), REPARTITION_BY_NUM" in plan
    monkeypatch.setattr(retrieve, "PART_CHUNKS", 1000, raising=False)
    assert [(r["question_id"], r["chunk_id"], r["rank"]) for r in retrieve.bm25_topk(asked, chunk_rows, 3).orderBy("question_id", "rank").collect()] == wanted


def test_texts_are_looked_up_by_few_hits(spark, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "gone", 2)], "question_id long, chunk_id string, rank int")
        texts = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "chunk_id string, text string")
        joins = {}
        for most in (10, 2):
            monkeypatch.setattr(retrieve, "SENT_HITS", most)
            df = retrieve.with_texts(hits, texts)
            joins[most] = "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
            assert sorted((r["question_id"], r["chunk_id"], r["rank"], r["text"]) for r in df.collect()) == [(1, "a", 1, "A"), (1, "b", 2, "B"), (2, "a", 1, "A")]
        assert joins == {10: True, 2: False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_queries_do_not_shuffle_texts(spark, sf_dir):
    """With joins by size alone out of the way, as where texts are large."""
    from insight_jobs.plans import docs

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = docs.merged_hits(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
