"""Moments, quantiles and frequent values of one or few scans against plain aggregates."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight_jobs.operators import correlate, moments, profile, quantiles


def some_numbers(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = pd.DataFrame({"a": x, "b": x * 2 + rng.normal(size=n), "const": 0.1, "far": 1e9 + rng.normal(size=n), "odd name": rng.integers(0, 3, n).astype(float)})
    t["gaps"] = np.where(rng.random(n) < 0.4, np.nan, x + rng.normal(size=n))
    t["steady"] = np.where(t["gaps"].isna(), x, 7.7)  # constant where gaps has values
    t["void"] = np.nan
    t["jump"] = np.where(np.arange(n) < n // 2, 0.0, 1e7)
    return t


def plain_pairs(t):
    out = {}
    for a, b in combinations(t.columns, 2):
        both = t[[a, b]].dropna()
        steady = len(both) == 0 or both[a].nunique() == 1 or both[b].nunique() == 1
        out[a, b] = None if steady else round(float(np.corrcoef(both[a], both[b])[0, 1]), 3)
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 0.0011)


@pytest.mark.parametrize("parts", [1, 5])
def test_correlations_of_one_scan(spark, parts):
    t = some_numbers()
    df = spark.createDataFrame(t).repartition(parts)
    got = {(r["col1"], r["col2"]): r["r"] for r in correlate.correlation_pairs(df).collect()}
    wanted = plain_pairs(t)
    assert got.keys() == wanted.keys()
    assert {k: (got[k], wanted[k]) for k in wanted if not close(got[k], wanted[k])} == {}


def test_one_scan_for_any_width(spark):
    df = spark.range(200).select(*[(F.col("id") * (k % 7 + 1) % (k + 3)).alias(f"c{k}") for k in range(120)])
    plan = moments.pearson_pairs(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1
    got = {(r["col1"], r["col2"]): r["r"] for r in correlate.correlation_pairs(df).collect()}
    t = df.toPandas()
    assert len(got) == 120 * 119 // 2
    for pair in [("c0", "c1"), ("c5", "c119"), ("c60", "c61")]:
        assert close(got[pair], round(float(np.corrcoef(t[pair[0]], t[pair[1]])[0, 1]), 3))


def test_correlations_of_few_rows_and_infinities(spark):
    none = spark.createDataFrame([], "a double, b double, c int")
    assert [tuple(r) for r in correlate.correlation_pairs(none).collect()] == [("a", "b", None), ("a", "c", None), ("b", "c", None)]
    assert correlate.correlation_pairs(none.select("a")).count() == 0
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert correlate.correlation_pairs(one).first()["r"] is None
    wild = spark.createDataFrame([(1.0, 1.0, None), (2.0, 3.0, 1.0), (3.0, 2.0, 5.0), (float("inf"), None, 2.0)], "a double, b double, c double")
    got = {(r["col1"], r["col2"]): r["r"] for r in correlate.correlation_pairs(wild).collect()}
    assert got["a", "b"] == 0.5 and got["b", "c"] == -1.0 and (got["a", "c"] is None or math.isnan(got["a", "c"]))


def shapes(n=3000):
    rng = np.random.default_rng(5)
    return pd.DataFrame({
        "plain": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "mass": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n) + 5),
        "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)), "void": np.nan, "same": 3.25, "sorted": np.arange(n) * 1.0,
    })


SHARES = [0.0, 0.25, 0.9]


@pytest.mark.parametrize("picked,grid", [(4000, 500), (3, 40)])
def test_exact_quantiles_by_selection(spark, picked, grid):
    t = shapes()
    if grid < 500:
        t = t[["ties", "mass", "gaps"]]
    got = {(r["column"], r["share"]): r["value"] for r in quantiles.exact_quantiles(spark.createDataFrame(t), list(t.columns), SHARES, picked=picked, grid=grid).collect()}
    for c in t.columns:
        v = t[c].dropna()
        for s in SHARES:
            assert got[c, s] == pytest.approx(float(np.quantile(v, s)), rel=1e-12) if len(v) else got[c, s] is None


@pytest.mark.parametrize("picked,grid", [(2, 40)])
def test_exact_quantiles_of_uneven_groups(spark, picked, grid):
    rng = np.random.default_rng(1)
    sizes = {"big": 2000, "two": 2, "one": 1, None: 7, "mid": 300}
    rows = [(g, float(x)) for g, n in sizes.items() for x in np.round(rng.normal(size=n), 2)] + [("void", None)]
    got = {(r["g"], r["share"]): r["value"] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], [0.25, 0.5], ["g"], picked, grid).collect()}
    for g in [*sizes, "void"]:
        for s in (0.25, 0.5):
            assert got[g, s] == (pytest.approx(quantiles.plain_quantile([x for h, x in rows if h == g and x is not None], s)) if g != "void" else None)
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["x"], [0.5], ["g"]).count() == 0
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["x"], [0.5]).first()["value"] is None


def test_frequent_values_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 6000
    t = pd.DataFrame({"zipf": np.minimum(rng.zipf(1.3, n), 10**6), "flat": rng.permutation(n), "few": rng.integers(0, 3, n), "text": [f"w{k}" for k in np.minimum(rng.zipf(1.6, n), 10**6)]})
    df = spark.createDataFrame(t).withColumn("void", F.lit(None).cast("int")).withColumn("gaps", F.when(F.col("few") > 0, F.col("few")))
    whole = []
    right = profile.all_counts
    monkeypatch.setattr(profile, "all_counts", lambda d, cols: whole.extend(cols) or right(d, cols))
    got = sorted((r["column"], r["rank"], r["value"], r["n"]) for r in profile.frequent_values(df, df.columns, 5, 64).collect())
    wanted = []
    for c in df.columns:
        counts = {}
        for r in df.select(c).collect():
            if r[0] is not None:
                counts[str(r[0])] = counts.get(str(r[0]), 0) + 1
        wanted += [(c, k, v, m) for k, (v, m) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    assert got == sorted(wanted)
    assert "flat" in whole and not {"few", "void", "gaps"} & set(whole)  # only what the summary leaves open is counted whole
    assert profile.value_counts(df.limit(0), None, 3).count() == 0
