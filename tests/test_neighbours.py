"""Exact neighbours against brute force, and what is made of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_jobs.operators import modeling, neighbours


def brute(x: np.ndarray, k: int):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out += [(i, int(j), r, round(float(d[j]), 9)) for r, j in enumerate(order, 1)]
    return sorted(out)


def found(spark, x, k, **more):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    return sorted((r["id"], r["other"], r["rank"], round(r["away"], 9)) for r in neighbours.neighbours(rows, k, **more).collect())


@pytest.mark.parametrize("pivots,part_rows", [(16, 10_000), (3, 40), (1, 25)])
def test_neighbours_by_brute_force(spark, pivots, part_rows):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(80, 3)) * 0.1 + 9, np.zeros((12, 3)), rng.integers(0, 3, (40, 3))])  # ties and repeats
    assert found(spark, x, 5, pivots=pivots, part_rows=part_rows) == brute(x, 5)


def test_neighbours_of_few_rows(spark):
    assert found(spark, np.empty((0, 2)), 3) == []
    assert found(spark, np.array([[1.0, 2.0]]), 3) == []
    assert found(spark, np.array([[1.0], [1.0], [4.0]]), 5) == brute(np.array([[1.0], [1.0], [4.0]]), 5)


def test_neighbours_of_twenty_thousand_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 20_000)] * 8 + rng.normal(size=(20_000, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = neighbours.neighbours(rows, 5, part_rows=4000)
    assert got.count() == 100_000
    some = {i: [] for i in range(0, 20_000, 97)}
    for r in got.where(F.col("id") % 97 == 0).orderBy("id", "rank").collect():
        some[r["id"]].append(r["other"])
    for i, mine in some.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert mine == np.argsort(d, kind="stable")[:5].tolist()


def test_balance_makes_rows_or_weights(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), "few" if i < 12 else "many") for i, (a, b) in enumerate(rng.normal(size=(212, 2)))] + [(None, 1.0, "few"), (1.0, 1.0, None)]
    train = spark.createDataFrame(rows, "a double, b double, y string")
    got = modeling.balanced_rows(train, "y", ["a", "b"])
    n = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert n["many"] == 200 and 180 <= n["few"] <= 220 and {r["weight"] for r in got.collect()} == {1.0}
    made = [(r["a"], r["b"]) for r in modeling.smote(train, "y", ["a", "b"], "few", 2).collect()]
    base = np.array([(a, b) for a, b, y in rows if y == "few" and a is not None])
    assert len(made) == 24 and all((base.min(0) - 1e-9 <= m).all() and (m <= base.max(0) + 1e-9).all() for m in np.array(made))
    tiny = train.where("y = 'many' OR (y = 'few' AND a > 0 AND b > 0)")
    n_few = tiny.where("y = 'few'").count()
    weighted = modeling.balanced_rows(tiny, "y", ["a", "b"], k=n_few)  # too few rows to make more from
    assert weighted.count() == 200 + n_few and len({r["weight"] for r in weighted.collect()}) == 2
    mild = spark.createDataFrame([(float(k), float(k), "x" if k % 4 == 0 else "y") for k in range(40)], "a double, b double, y string")
    assert {round(r["weight"], 3) for r in modeling.balanced_rows(mild, "y", ["a", "b"]).collect()} == {2.0, 0.667}
    even = mild.withColumn("y", F.when(F.col("a") < 20, "x").otherwise("y"))
    assert {r["weight"] for r in modeling.balanced_rows(even, "y", ["a", "b"]).collect()} == {1.0}


def test_a_row_is_sent_once_to_a_part(spark, monkeypatch):
    """Where no cell can be ruled out, what is sent grows with the parts, not with the cells."""
    x = np.random.default_rng(5).normal(size=(600, 48))
    sent = []
    plain = neighbours.asked_of
    monkeypatch.setattr(neighbours, "asked_of", lambda members, asking, *more: sent.append(asking.count()) or plain(members, asking, *more))
    assert found(spark, x, 5, pivots=64, part_rows=300) == brute(x, 5)
    assert sent[-1] <= 4 * len(x)


def test_rows_far_from_the_origin_keep_their_order(spark):
    x = 1e8 + np.random.default_rng(6).normal(size=(300, 4))
    assert found(spark, x, 4, pivots=8, part_rows=100) == brute(x, 4)
