"""Keyed tables, streams, the keyword index, dense search and CSV: restarts, crashes, plans and brute force."""

from __future__ import annotations

import os
import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from insight_jobs.operators import dense, keyword_index, retrieve
from insight_jobs.sources import io, shared
from insight_jobs.sources.keyed import KeyedTable
from insight_jobs.streaming import streams

DDL = "k long, part string, v string"


def files(table: KeyedTable) -> dict[str, float]:
    """Data files and their times, by path."""
    top = f"{table.path}/data"
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(top) for n in names if n.endswith(".parquet")}


def current_files(table: KeyedTable) -> set[str]:
    told = table.manifest()["current"]
    return {f for f in files(table) if any(f"gen={g}/bucket={b}/" in f for b, gens in told.items() for g in gens)}


@pytest.fixture
def kept(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), DDL, ["k", "part"], ["k"], buckets=8)
    table.append(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("part"), F.lit("old").alias("v")))
    yield table
    table.drop()


def test_an_upsert_rewrites_only_its_buckets(spark, kept):
    before = current_files(kept)
    changed = spark.createDataFrame([(3, "a", "new"), (3, "b", "more"), (None, "a", "lost"), (500, "a", "x"), (500, "a", "w")], DDL)
    touched = kept.upsert(changed, order=["v"])
    after = current_files(kept)
    assert len(touched) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in before - after} <= set(touched)
    assert len(before & after) >= 6
    got = {(r["k"], r["part"]): r["v"] for r in kept.read().collect()}
    assert len(got) == 202 and got[3, "a"] == "new" and got[3, "b"] == "more" and got[500, "a"] == "w" and got[4, "a"] == "old"


def test_changes_that_stop_before_the_manifest_leave_the_table(spark, kept, monkeypatch):
    before, rows = current_files(kept), sorted(map(tuple, kept.read().collect()))
    monkeypatch.setattr(kept, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        kept.upsert(spark.createDataFrame([(3, "a", "new")], DDL))
    with pytest.raises(RuntimeError):
        kept.delete(spark.createDataFrame([(3, "a")], "k long, part string"))
    monkeypatch.undo()
    assert current_files(kept) == before and sorted(map(tuple, kept.read().collect())) == rows
    assert len(kept.vacuum()) >= 1 and set(files(kept)) == before and sorted(map(tuple, KeyedTable.open(spark, kept.path).read().collect())) == rows


def test_a_second_writer_fails_and_changes_nothing(spark, kept, monkeypatch):
    told = kept.manifest()
    kept.upsert(spark.createDataFrame([(3, "a", "first")], DDL))
    monkeypatch.setattr(kept, "manifest", lambda: told)
    with pytest.raises(FileExistsError):
        kept.upsert(spark.createDataFrame([(3, "a", "second")], DDL))
    monkeypatch.undo()
    assert kept.read().where("k = 3").first()["v"] == "first"


def test_delete_update_add_and_replace(spark, kept):
    kept.delete(spark.createDataFrame([(1,), (2,), (9999,)], "k long"), ["k"])
    kept.update(spark.createDataFrame([(3, "a", "set"), (4, "zz", "no"), (5, "a", None)], DDL), ["v"])
    got = {r["k"]: r["v"] for r in kept.read().collect()}
    assert len(got) == 198 and got[3] == "set" and got[4] == "old" and got[5] is None
    with pytest.raises(ValueError):
        kept.delete(spark.createDataFrame([("a",)], "part string"), ["part"])
    kept.replace(spark.createDataFrame([(7,), (8,)], "k long"), spark.createDataFrame([(7, "x", "1"), (7, "y", "2")], DDL))
    assert sorted((r["k"], r["part"]) for r in kept.read().where("k IN (7, 8)").collect()) == [(7, "x"), (7, "y")] and kept.read().count() == 198
    sums = KeyedTable.create(spark, f"{kept.path}-sums", "k long, n long", ["k"], buckets=2)
    for rows in ([(1, 2), (2, 5)], [(1, -2), (2, 1), (3, 1)], []):
        sums.add(spark.createDataFrame(rows, "k long, n long"), ["n"])
    assert sorted(map(tuple, sums.read().collect())) == [(2, 6), (3, 1)]


def test_stored_rows_are_joined_where_they_lie(spark, kept):
    small = kept.session.createDataFrame([(3, "a", "new")], DDL).repartition(8, "k")
    kept.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = kept._replaced(kept._rows(kept.session, kept.manifest(), None), small)._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "REPARTITION_BY_NUM" in stored


def test_a_bucket_of_many_generations_is_made_one(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "g"), "k long, v long", ["k"], buckets=1)
    merged = [table.append(spark.createDataFrame([(n, n)], "k long, v long"), most_generations=3) for n in range(5)]
    assert merged == [[], [], [], [0], []] and sorted(r["k"] for r in table.read().collect()) == list(range(5))
    assert KeyedTable.at(spark, table.path, "k long, v long", ["k"]).manifest()["version"] == 5
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, table.path, "k long, v long", ["k"])


DOCS = "doc_id string, text string"


def nodes(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("node_id", "text"))


def ingest(spark, base, name="ingest"):
    streams.stream_ingest(spark, f"{base}/in", DOCS, f"{base}/out", f"{base}/check-{name}", nodes, ["doc_id", "node_id"], name, 4, "text").awaitTermination()
    return sorted(map(tuple, KeyedTable.open(spark, f"{base}/out").read().collect()))


def test_ingest_stream_equals_batch_over_restarts(spark, tmp_path):
    base = str(tmp_path)
    parts = [[("a", "one two"), ("b", "three"), ("a", "one two"), (None, "no id")], [("a", "changed text"), ("c", "  four")], [("d", None), ("e", "x " * 3000)]]
    for part in parts:
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        got = ingest(spark, base)
    batch = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("c", 2, "four"), *[("e", k, "x") for k in range(3000)]]
    assert got == sorted(batch)
    assert ingest(spark, base) == got  # nothing new
    assert ingest(spark, base, "again") == got  # a stream without a past leaves out what the sink has


def test_a_batch_that_is_tried_again_adds_nothing_twice(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    spark.createDataFrame([("a", "one two"), ("b", "three")], DOCS).write.parquet(f"{base}/in")
    right = KeyedTable.append

    def stops(self, *args, **more):
        right(self, *args, **more)
        raise RuntimeError("lost after the manifest")

    monkeypatch.setattr(KeyedTable, "append", stops)
    with pytest.raises(StreamingQueryException):
        ingest(spark, base)
    monkeypatch.undo()
    assert ingest(spark, base) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")]
    spark.createDataFrame([("c", "four")], DOCS).write.mode("append").parquet(f"{base}/in")
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the manifest")))
    with pytest.raises(StreamingQueryException):
        ingest(spark, base)
    monkeypatch.undo()
    assert ingest(spark, base)[-1] == ("c", 0, "four")


def test_a_batch_reads_no_sink(spark, tmp_path, monkeypatch):
    base, read = str(tmp_path), []
    right = KeyedTable._rows
    monkeypatch.setattr(KeyedTable, "_rows", lambda self, *a: read.append(a) or right(self, *a))
    for k in range(3):
        spark.createDataFrame([(f"d{k}", "some text")], DOCS).write.mode("append").parquet(f"{base}/in")
        streams.stream_ingest(spark, f"{base}/in", DOCS, f"{base}/out", f"{base}/check", nodes, ["doc_id", "node_id"], buckets=4).awaitTermination()
    assert read == []
    assert KeyedTable.open(spark, f"{base}/out").read().count() == 6


def test_session_stream_keeps_one_row_a_session(spark, tmp_path):
    base, schema = str(tmp_path), "session_id long, created_at timestamp"
    for k in range(3):
        spark.sql(f"SELECT s AS session_id, timestamp_seconds(100 * {k} + s) AS created_at FROM VALUES (1L), (2L), ({k + 1}L), (NULL) t(s)").write.mode("append").parquet(f"{base}/in")
        streams.stream_turns(spark, f"{base}/in", schema, f"{base}/out", f"{base}/check", buckets=4).awaitTermination()
    batch = spark.read.schema(schema).parquet(f"{base}/in").where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("turns"), F.max("created_at").alias("updated_at"))
    assert sorted(map(tuple, streams.current_sessions(spark, f"{base}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_whole_rows_are_shuffled_and_written_once(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "once"), "k long, v long", ["k"], buckets=4)
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")))
    first = files(table)
    assert set(first) == current_files(table) and not shared.names_in(spark, f"{table.path}/incoming")
    rows = spark.range(90, 110).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("v"))
    assert table.put(table.stage(rows), spark.createDataFrame([(95,), (1,), (7777,), (None,)], "k long")) == [0, 1, 2, 3]
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert set(got) == set(range(110)) - {95, 1} and got[94] == 2 and got[108] == 2 and got[5] == 1
    staged = table.staged(table.stage(rows)).join(table.where_it_lies(), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in staged


def test_postings_are_made_where_chunks_lie(spark, tmp_path):
    rows = some_chunks(200, 3)
    index = keyword_index.KeywordIndex.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "i"), blocks=32, buckets=4)
    chunks, blocks = index.tables["chunks"], index.tables["blocks"]
    per_bucket = {r["b"]: r["n"] for r in spark.createDataFrame([(b,) for b in index.labels], "block int").groupBy(chunks.bucket().alias("b")).agg(F.count("*").alias("n")).collect()}
    assert per_bucket == {b: 8 for b in range(4)}
    plan = chunks.where_it_lies().groupBy("block", "scope").agg(F.sum("dl"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and blocks.by == chunks.by == ["block"]
    got = {r["chunk_id"]: (r["dl"], {t["term"]: t["tf"] for t in r["terms"]}) for r in chunks.read().collect()}
    assert got == {c: (len(t.split()), dict(Counter(t.lower().split()))) for _, c, t in rows}


WORDS = ["the", "of", *[f"w{k}" for k in range(60)]]


def some_chunks(n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, [30, 20, *[1 + 60 / (k + 1) for k in range(60)]], k=rng.randrange(1, 40))) for _ in range(n)]
    return [("s" if k % 3 else "t", k, t.upper() if k % 2 else t) for k, t in enumerate(texts)]


CHUNKS = "scope string, chunk_id long, text string"


def brute_bm25(chunks, questions, k, keep_zero=False):
    out = []
    for q, scope, text in questions:
        docs = {c: Counter((t or "").lower().split()) for s, c, t in chunks if s == scope}
        if not docs:
            continue
        mean_len = sum(sum(d.values()) for d in docs.values()) / len(docs)
        df = Counter(w for d in docs.values() for w in d)
        raw = {w: log(len(docs) - f + 0.5) - log(f + 0.5) for w, f in df.items()}
        idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
        scores = {}
        for c, d in docs.items():
            met = [w for w in text.lower().split() if w in d]
            if met:
                scores[c] = sum(idf[w] * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean_len)) for w in met)
        best = sorted((c for c in scores if keep_zero or scores[c] > 0), key=lambda c: (-round(scores[c], 9), c))[:k]
        out += [(q, c, r, round(scores[c], 6)) for r, c in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("keep_zero", [False, True])
def test_keyword_index_equals_brute_force_after_changes(spark, tmp_path, keep_zero):
    first, now = some_chunks(300, 1), some_chunks(300, 1)
    now[5:40] = [("s" if k % 3 else "t", k, t) for k, (_, _, t) in enumerate(some_chunks(40, 9)) if k >= 5]
    now[50] = (now[50][0], 50, None)
    now[51] = (now[51][0], 51, "")
    gone = {60, 61, 299}
    index = keyword_index.KeywordIndex.build(spark.createDataFrame(first, CHUNKS), str(tmp_path / "i"), blocks=32, buckets=4)
    changed = [r for r, f in zip(now, first, strict=True) if r != f]
    index.change(spark.createDataFrame([*changed, ("s", 1000, "the w1 w1 new"), (None, 1, "x"), ("s", None, "x")], CHUNKS), spark.createDataFrame([(now[g][0], g) for g in gone] + [("s", 7777)], "scope string, chunk_id long"))
    rows = [r for r in now if r[1] not in gone] + [("s", 1000, "the w1 w1 new")]
    anew = keyword_index.KeywordIndex.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "j"), blocks=32, buckets=4)
    for t in keyword_index.TABLES:
        mine, wanted = (sorted(map(str, i.tables[t].read().collect())) for i in (index, anew))
        assert mine == wanted, t
    questions = [(1, "s", "w1 w2 w2 new"), (2, "t", "the of THE"), (3, "s", "w59 w58 w7 of nowhere"), (4, "u", "w1"), (5, "t", "nowhere")]
    got = index.topk(spark.createDataFrame(questions, "question_id long, scope string, text string"), 7, keep_zero, first_blocks=3)
    assert sorted((r["question_id"], r["chunk_id"], r["rank"], round(r["score"], 6)) for r in got.collect()) == brute_bm25(rows, questions, 7, keep_zero)


def test_bounds_spare_postings(spark, tmp_path):
    rows = [("s", k, "alpha beta gamma" if k == 77 else f"alpha filler{k % 7} {'more ' * (k % 5)}") for k in range(400)]
    index = keyword_index.KeywordIndex.build(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "i"), blocks=64, buckets=4)
    asked = spark.createDataFrame([(1, "s", "alpha beta gamma")], "question_id long, scope string, text string")
    read = index.search_report(asked, 1, first_blocks=2).first()
    assert read["postings"] == 402 and read["postings_read"] < 100
    assert index.topk(asked, 1, first_blocks=2).first()["chunk_id"] == 77


def brute_dense(vectors, questions, k):
    out = []
    for q, scope, v in questions:
        score = {}
        for c, s, x in vectors:
            if s == scope and scope is not None and x is not None and len(x) == 3 and v is not None:
                a, b = np.array(x), np.array(v)
                score[c] = round(float(a @ b / (max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12))), 9)
        out += [(q, c, r, score[c]) for r, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:k], 1)]
    return sorted(out)


def test_dense_search_within_scopes(spark):
    rng = np.random.default_rng(0)
    scopes = ["big"] * 300 + [f"s{k % 60}" for k in range(300)]  # one scope has half of all rows
    vectors = [(f"c{k:04d}", s, rng.normal(size=3).tolist()) for k, s in enumerate(scopes)]
    vectors += [("n1", None, [1.0, 0.0, 0.0]), ("n2", "big", None), ("n3", "big", [1.0]), ("z", "s1", [0.0, 0.0, 0.0])]
    questions = [(k, s, rng.normal(size=3).tolist()) for k, s in enumerate(["big", "s1", "s59", "none", "big", None])] + [(9, "big", None)]
    base = spark.createDataFrame(vectors, "chunk_id string, scope string, embedding array<double>")
    asked = spark.createDataFrame(questions, "question_id long, scope string, embedding array<double>")
    for block_rows, group_rows in ((1000, 100), (40, 1)):
        got = dense.dense_topk(asked, base, 6, "scope", block_rows, group_rows)
        assert sorted((r["question_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in got.collect()) == brute_dense(vectors, questions, 6)
    assert dense.dense_topk(asked, base.limit(0), 3, "scope").count() == 0 and dense.dense_topk(asked.limit(0), base, 3).count() == 0


def test_large_scopes_are_dealt_into_parts(spark):
    base = spark.range(1000).select(F.when(F.col("id") < 600, "big").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("scope"), F.col("id").alias("chunk_id"))
    asked = spark.createDataFrame([("big", 1), ("s700", 2)], "scope string, question_id long")
    parts, every = dense.with_parts(base, asked, 100)
    sizes = [r["count"] for r in parts.where("scope = 'big'").groupBy("part").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 200 and every.groupBy("scope").count().where("scope = 'big'").first()["count"] == 6 and every.count() == 7


def recall(found, exact) -> float:
    pairs = lambda df: {(r["question_id"], r["chunk_id"]) for r in df.collect()}
    wanted = pairs(exact)
    return len(pairs(found) & wanted) / len(wanted)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_cells_and_projections(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    base, asked = rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    exact = dense.dense_topk(asked, base, 10)
    path = str(tmp_path / "cells")
    assert dense.build_cells(base, path).agg(F.sum("n")).first()[0] == rows.count()
    found = dense.dense_topk_cells(spark, asked, path, 10)
    assert recall(found, exact) >= 0.9 and dense.share_read(spark, path, asked) < 0.9
    assert recall(retrieve.dense_topk_lsh(asked, base, 10), exact) >= 0.9


def test_cells_read_only_what_is_asked_for(spark, tmp_path):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(8, 16)) * 5
    rows = [(k, (middle[k % 8] + rng.normal(size=16)).tolist()) for k in range(800)]
    base = spark.createDataFrame([*rows, (900, None), (901, [1.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, rows[0][1]), (1, None)], "question_id long, embedding array<double>")
    path = str(tmp_path / "cells")
    dense.build_cells(base, path, cells=8)
    found = dense.dense_topk_cells(spark, asked, path, 10, share=0.1)
    assert recall(found, dense.dense_topk(asked, base, 10)) == 1.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan
    assert dense.share_read(spark, path, asked.where("question_id = 0"), 0.1) < 0.3
    with pytest.raises(ValueError):
        dense.build_cells(base.limit(0), str(tmp_path / "none"))


TEXTS = ['say "hi", now', "back\\slash \\\"", "two\nlines", "carriage\r\nreturn", " edge spaces ", "comma, 'single'", '"', "ünï 漢字", "a" * 50_000]


def test_csv_round_trip_loses_nothing(spark, tmp_path):
    rows = [(k, t, k % 2 == 0, 0.1 * k) for k, t in enumerate(TEXTS)] + [(90, "", None, None), (91, None, True, float("nan"))]
    df = spark.createDataFrame(rows, "`id` long, `te\"xt` string, flag boolean, x double").selectExpr("*", "timestamp'2024-01-01 10:00:00.123456' AS at", "date'2024-02-03' AS day", "CAST(12345678901234567890123 AS decimal(38,0)) AS wide")
    path = io.write_table(df, str(tmp_path), "id", "all", "1")
    got = io.read_table(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", 'te"xt': "string", "flag": "boolean", "x": "double", "at": "timestamp", "day": "date", "wide": "decimal(38,0)"}
    back = {r["id"]: r for r in got.collect()}
    assert [back[k]['te"xt'] for k in range(len(TEXTS))] == TEXTS and back[90]['te"xt'] is None and back[91]["x"] is None
    assert str(back[0]["at"]) == "2024-01-01 10:00:00.123456" and str(back[0]["day"]) == "2024-02-03" and int(back[0]["wide"]) == 12345678901234567890123
    assert [back[k]["x"] for k in range(len(TEXTS))] == [0.1 * k for k in range(len(TEXTS))]


def test_csv_types_are_the_narrowest(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,l,d,f,day,at,mixed,none,e,odd\ntrue,1,99999999999999999999,1.5,2024-01-01,2024-01-01,2024-01-01,,1e5,1d\nFALSE,-2,1,2,2024-1-2,2024-01-02 10:00:00,5,NA,3,2\n,,,nan,,2024-01-02T11:00:00Z,,null,,\n")
    got = io.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes) == {"b": "boolean", "l": "bigint", "d": "decimal(38,0)", "f": "double", "day": "date", "at": "timestamp", "mixed": "string", "none": "string", "e": "double", "odd": "string"}
    assert [r["b"] for r in got.collect()] == [True, False, None] and [r["f"] for r in got.collect()] == [1.5, 2.0, None]
    assert [str(r["at"]) for r in got.collect()] == ["2024-01-01 00:00:00", "2024-01-02 10:00:00", "2024-01-02 11:00:00"]


def test_torn_lines_come_back_with_their_reason(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,"x, y",12\n')
    table, rejected = io.read_checked(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, table.collect())) == [(1, "2", 3), (10, "x, y", 12)]
    assert sorted(map(tuple, rejected.collect())) == [("4,5", "fewer fields than the header, or an empty last one"), ("6,7,8,9", "more fields than the header")]
    table, rejected = io.read_checked(spark, str(tmp_path / "t.csv"), "a int, b string, c int")
    assert table.count() == 2 and rejected.count() == 2
    (tmp_path / "u.csv").write_text("a,b\nx,1\n3,2\n")
    table, rejected = io.read_checked(spark, str(tmp_path / "u.csv"), "a int, b int")
    assert [tuple(r) for r in table.collect()] == [(3, 2)] and [r["record"] for r in rejected.collect()] == ["x,1"]


def test_shared_files(spark, tmp_path):
    path = f"{tmp_path}/f.json"
    shared.write_new(spark, path, "é")
    assert shared.read_text(spark, path) == "é" and shared.names_in(spark, str(tmp_path)) and not shared.names_in(spark, f"{tmp_path}/none")
    with pytest.raises(FileExistsError):
        shared.write_new(spark, path, "x")
    assert shared.read_text(spark, path) == "é"
