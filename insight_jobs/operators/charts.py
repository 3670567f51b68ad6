"""The aggregates behind charts; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import categorical_columns, discrete_columns, name, numeric_columns, quantiles, value, value_counts
from .quantiles import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1), low, high, n; empty bins are kept, a constant column has one bin."""
    x = value(column)
    limits = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo IS NOT NULL")
    place = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int") + 1, F.lit(bins)))
    counts = df.select(x.alias("x")).where("x IS NOT NULL").join(F.broadcast(limits)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    every = limits.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins))).alias("bin"))
    width = F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise((F.col("hi") - F.col("lo")) / bins)
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * width, 4).alias("low"), F.round(F.col("lo") + F.col("bin") * width, 4).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def bar_counts(df: DataFrame, column: str, top: int = 1000) -> DataFrame:
    """value, n, rank: the bars of a chart, the most frequent values."""
    return value_counts(df, [column], top).select("value", "n", "rank")


def auto_distribution(df: DataFrame, max_unique: int = 15, bins: int = 30) -> DataFrame:
    """column, kind (bar or histogram), label, n: counts of categories and discrete numbers, bins of the rest."""
    discrete = {r["column"] for r in discrete_columns(df, max_unique).select("column").collect()}  # names of columns
    bars = [*categorical_columns(df), *[c for c in numeric_columns(df) if c in discrete]]
    out = value_counts(df, bars).select("column", F.lit("bar").alias("kind"), F.col("value").alias("label"), "n") if bars else None
    for c in numeric_columns(df):
        if c not in discrete:
            h = histogram(df, c, bins).select(F.lit(c).alias("column"), F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("label"), "n")
            out = h if out is None else out.union(h)
    return out


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, one_in: int = 1) -> DataFrame:
    """Points with both values; one_in keeps a share of rows, chosen by a hash of their values."""
    kept = df.where(value(x).isNotNull() & value(y).isNotNull() & (F.pmod(F.xxhash64(name(x), name(y)), F.lit(one_in)) == 0))
    return kept.select(value(x).alias("x"), value(y).alias("y"), *([name(color).cast("string").alias("color")] if color else []))


def pair_points(df: DataFrame, k: int = 6, one_in: int = 1) -> DataFrame:
    columns = numeric_columns(df)[:k]
    return df.where(F.pmod(F.xxhash64(*[name(c) for c in columns]), F.lit(one_in)) == 0).select(*[name(c) for c in columns])


def box_stats(df: DataFrame, column: str, group: str | None = None, exact: bool = True) -> DataFrame:
    """Quartiles (exact: see quantiles), whiskers within 1.5 box lengths, and the count of values beyond them, by group."""
    rows = df.select((name(group).cast("string") if group else F.lit("all")).alias("group"), value(column).alias("x")).where("x IS NOT NULL")
    if exact:
        at = exact_quantiles(rows, ["x"], [0.25, 0.5, 0.75], ["group"])
        boxes = at.groupBy(F.col("group").alias("g")).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    else:
        boxes = rows.groupBy("group").agg(quantiles(F.col("x"), [0.25, 0.5, 0.75], exact).alias("q"))
        boxes = boxes.select(F.col("group").alias("g"), *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    out = rows.join(boxes, F.col("group").eqNullSafe(F.col("g"))).drop("g").groupBy("group", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("n_outliers"))
    return out.select("group", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "low", "high")], "n_outliers")


def pie_shares(df: DataFrame, column: str) -> DataFrame:
    counts = value_counts(df, [column])
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # one row


def line_series(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """x, y: an aggregate by x, in the order of x."""
    return df.groupBy(x.alias("x")).agg(y.alias("y")).orderBy("x")


def model_comparison_long(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(result_set, model, metric, score); a set that holds a generic model name is left out whole."""
    generic = results.groupBy("result_set").agg(F.bool_or(F.lower("model").rlike(r"^model[\s_\-]?[a-z0-9]$")).alias("generic")).where("generic").select("result_set")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics]))
    return results.join(generic, "result_set", "left_anti").select("result_set", "model", pairs.alias("p")).select("result_set", "model", "p.metric", "p.score").where("score IS NOT NULL")


def word_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(name(column).cast("string")), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)
