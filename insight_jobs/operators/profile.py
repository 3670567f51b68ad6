"""Column profiles of a table as long results, one row for each column (or column and value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import shared


#: Hash parts of a ranking.
PARTS = 64


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text and dates; booleans are neither numbers nor categories."""
    kinds = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def value(column: str) -> Column:
    """A numeric column as double, NaN as null."""
    x = name(column).cast("double")
    return F.when(~F.isnan(x), x)


def one_pass(df: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    """Aggregates of many columns in one pass, then a row for each column: column and the fields.

    fields: name to a function from a column's name to its aggregate.
    """
    if not columns:
        kinds = df.agg(*[make(df.columns[0]).alias(k) for k, make in fields.items()]).schema if df.columns else T.StructType()
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("column", T.StringType()), *kinds.fields]))
    wide = df.agg(*[make(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, make in fields.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in fields]) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_shape(df: DataFrame) -> DataFrame:
    """n_rows, n_columns and, for each column, its place and type."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kind).alias("dtype")) for i, (c, kind) in enumerate(df.dtypes)]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.explode(F.array(*rows)).alias("r")).select("n_rows", "n_columns", "r.*")


def is_missing(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    missing = name(column).isNull()
    return missing | F.isnan(name(column)) if isinstance(kind, (T.DoubleType, T.FloatType)) else missing


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_nulls, of every column, in one pass; their sum is the table's null total."""
    return one_pass(df, df.columns, {"n_nulls": lambda c: F.count_if(is_missing(df, c))})


def quantiles(c: str | Column, shares: list[float], exact: bool) -> Column:
    """Quantiles of a column by name (or of an expression), as an array.

    exact: interpolated, which holds a count for each distinct value; else approximate ones of bounded size.
    """
    x = value(c) if isinstance(c, str) else c
    return F.percentile(x, F.array(*map(F.lit, shares))) if exact else F.percentile_approx(x, shares, 10_000)


def median(c: str, exact: bool) -> Column:
    return F.get(quantiles(c, [0.5], exact), F.lit(0))


def with_quantiles(out: DataFrame, df: DataFrame, columns: list[str], names: dict[str, float]) -> DataFrame:
    """Add exact quantiles (name to share) to rows of columns, counted and ranked in parts: no task holds a column's distinct values."""
    from .quantiles import counted_quantiles

    found = counted_quantiles(df.select(*[name(c) for c in columns]), columns, sorted(set(names.values()))) if columns else out.select("column", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("value"))
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in names.items()])
    return out.join(wide, "column", "left")  # a row for each column


def numeric_summary(df: DataFrame, digits: int = 3, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max of each numeric column.

    exact: interpolated (operators.quantiles); else approximate, in the one pass.
    """
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    fields = {"count": lambda c: F.count(value(c)), "mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev_samp(value(c)), "min": lambda c: F.min(value(c)), "max": lambda c: F.max(value(c))}
    if exact:
        out = with_quantiles(one_pass(df, numeric_columns(df), fields), df, numeric_columns(df), names)
    else:
        out = one_pass(df, numeric_columns(df), fields | {"q": lambda c: quantiles(c, list(names.values()), exact)})
        out = out.select("*", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return out.select("column", "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", *names, "max")])


def corrected_skew(c: str) -> Column:
    """Bias-corrected skew: null under three values, 0 for a constant column."""
    n = F.count(value(c)).cast("double")
    return F.when(n < 3, F.lit(None)).when(F.min(value(c)) == F.max(value(c)), F.lit(0.0)).otherwise(F.skewness(value(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def column_stats(df: DataFrame, digits: int = 2, exact: bool = True) -> DataFrame:
    """mean, median (exact: see numeric_summary), std and skew of each numeric column."""
    fields = {"mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev_samp(value(c)), "skew": corrected_skew}
    if exact:
        out = with_quantiles(one_pass(df, numeric_columns(df), fields), df, numeric_columns(df), {"median": 0.5})
    else:
        out = one_pass(df, numeric_columns(df), fields | {"median": lambda c: median(c, exact)})
    return out.select("column", *[F.round(k, digits).alias(k) for k in ("mean", "median", "std", "skew")])


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text), nulls and NaN left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), name(c).cast("string")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")


def value_counts(df: DataFrame, columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """column, value, n: counts of each column's values; with `top` the most frequent ones and their rank, ties by value."""
    columns = columns or df.columns
    return all_counts(df, columns) if top is None else frequent_values(df, columns, top)


def all_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def best_counts(counted: DataFrame, top: int) -> DataFrame:
    """The `top` most frequent values of each column with their rank.

    The best of each of PARTS hash parts are found first, so that a rank is taken over PARTS x top rows at most.
    """
    order = [F.desc("n"), "value"]
    part = F.pmod(F.xxhash64("value"), F.lit(PARTS))
    best = counted.withColumn("_rank", F.row_number().over(Window.partitionBy("column", part).orderBy(*order))).where(F.col("_rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= top).drop("_rank")


#: A summary that tracks m items misses none that make up more than this over m of all rows.
SUMMARY_ERROR = 3.5


def frequent_values(df: DataFrame, columns: list[str], top: int, tracked: int = 2_000) -> DataFrame:
    """column, value, n, rank of the most frequent values, exactly, without shuffling every distinct value.

    A first pass keeps a mergeable summary of `tracked` items for each column and so names candidates; a second one counts
    only these. A value that isn't among them occurs SUMMARY_ERROR / tracked of all rows at most, so that the counts stand
    where the last of the best is above that, or where the candidates are all there is. Other columns are counted whole.
    """
    tracked = max(tracked, top)
    text = {c: F.when(~is_missing(df, c), name(c).cast("string")) for c in columns}
    pairs = [F.struct(F.lit(c).alias("column"), F.count(t).alias("rows"), F.call_function("approx_top_k", t, F.lit(tracked), F.lit(tracked)).alias("items")) for c, t in text.items()]
    summary = df.agg(F.count(F.lit(1)).alias("all"), F.array(*pairs).alias("p")).select("all", F.explode("p").alias("p")).select("all", "p.column", "p.rows", "p.items")
    summary = shared.written(summary, shared.fresh_dir(df.sparkSession, "summary"))  # `tracked` items a column
    candidates = summary.select("column", F.explode("items.item").alias("value")).where("value IS NOT NULL").distinct()
    counted = long_values(df, columns).join(F.broadcast(candidates), ["column", "value"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = shared.written(counted, shared.fresh_dir(df.sparkSession, "counts"))
    last = F.get(F.sort_array(F.collect_list("n"), asc=False), F.lit(top - 1))
    told = counted.groupBy("column").agg(F.sum("n").alias("met"), last.alias("last")).join(summary.select("column", "all", "rows"), "column")
    known = {r["column"] for r in told.collect() if r["met"] == r["rows"] or (r["last"] or 0) > SUMMARY_ERROR / tracked * r["all"]}  # a row a column
    known |= {r["column"] for r in summary.where("rows = 0").select("column").collect()}
    rest = [c for c in columns if c not in known]
    found = counted.where(F.col("column").isin([*known])) if known else counted.limit(0)
    return best_counts(found.union(all_counts(df, rest)) if rest else found, top)


def discrete_columns(df: DataFrame, max_unique: int = 15) -> DataFrame:
    """Numeric columns with at most `max_unique` distinct values, and these in order.

    A first pass estimates distinct counts, so that only columns near the limit are counted exactly.
    """
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_unique long, `values` array<double>")
    rough = df.agg(*[F.approx_count_distinct(value(c), 0.05).alias(str(i)) for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if rough[i] <= 2 * max_unique + 5]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in near or columns[:1]])
    distinct = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    return distinct.groupBy("column").agg(F.count("value").alias("n_unique"), F.array_sort(F.collect_list("value")).alias("values")).where(F.col("n_unique") <= max_unique)


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_unique, mode (the smallest of equals), its count and the nulls of each categorical column."""
    columns = columns or categorical_columns(df)
    counted = long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("mode_count"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return null_counts(df.select(*[name(c) for c in columns])).join(F.broadcast(modes), "column", "left").select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "mode", "mode_count", "n_nulls")  # a row for each column


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_duplicates: rows that repeat an earlier one, nulls being equal."""
    groups = df.groupBy(*[name(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def id_like_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with as many distinct values as rows; estimates first, exact counts for the rest."""
    columns = columns or df.columns
    rough = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(name(c), 0.05).alias(str(i)) for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if rough[i + 1] >= 0.8 * rough["n"]]
    found = one_pass(df, near, {"n_unique": lambda c: F.count_distinct(name(c)), "n_rows": lambda c: F.count(F.lit(1))}) if near else df.sparkSession.createDataFrame([], "column string, n_unique long, n_rows long")
    return found.where("n_unique = n_rows").select("column", "n_unique")


def column_samples(df: DataFrame, order_by: list[str], n: int = 3, columns: list[str] | None = None) -> DataFrame:
    """column, position, value: the first n values of each column in the given order, nulls left out."""
    picked = []
    for c in columns or df.columns:
        rows = df.where(~is_missing(df, c)).orderBy(*order_by).limit(n).select(F.lit(c).alias("column"), name(c).cast("string").alias("value"), F.struct(*order_by).alias("o"))
        picked.append(rows.select("column", "value", F.row_number().over(Window.partitionBy("column").orderBy("o")).alias("position")))
    return reduce(DataFrame.union, picked)


def stat_profile(df: DataFrame, max_numeric: int = 10, max_categorical: int = 6, digits: int = 3, exact: bool = True) -> DataFrame:
    """The whole profile as (section, column, metric, value): shape, numeric, categorical, nulls, duplicates.

    Three scans: one for all plain aggregates, one that counts texts' values, one for repeated rows.

    exact: see numeric_summary, here of the medians, which take some scans more.
    """
    numeric, text = numeric_columns(df)[:max_numeric], categorical_columns(df)[:max_categorical]
    fields = {"mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev_samp(value(c)), "min": lambda c: F.min(value(c)), "max": lambda c: F.max(value(c))} | ({} if exact else {"median": lambda c: median(c, exact)})
    nulls = {c: f"z{k}" for k, c in enumerate(df.columns)}
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(z) for c, z in nulls.items()], *[make(c).alias(f"{m}_{k}") for k, c in enumerate(numeric) for m, make in fields.items()])
    row = lambda section, column, metric, v: F.struct(F.lit(section).alias("section"), F.lit(column).alias("column"), F.lit(metric).alias("metric"), v.cast("double").alias("value"))
    total = F.lit(0)
    for z in nulls.values():
        total = total + F.col(z)
    rows = [row("shape", "", "n_rows", F.col("n")), row("shape", "", "n_columns", F.lit(len(df.columns))), row("table", "", "null_total", total)]
    rows += [row("numeric", c, m, F.col(f"{m}_{k}")) for k, c in enumerate(numeric) for m in fields] + [row("numeric", c, "nulls", F.col(nulls[c])) for c in numeric]
    rows += [row("categorical", c, "n_nulls", F.col(nulls[c])) for c in text]
    each = lambda metrics: F.explode(F.array(*metrics)).alias("m")
    parts = [wide.select(each(rows))]
    if exact and numeric:
        medians = with_quantiles(df.sparkSession.createDataFrame([(c,) for c in numeric], "column string"), df, numeric, {"median": 0.5})
        parts.append(medians.select(F.struct(F.lit("numeric").alias("section"), F.col("column"), F.lit("median").alias("metric"), F.col("median").alias("value")).alias("m")))
    if text:
        counted = value_counts(df, text).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("mode_count"))
        known = df.sparkSession.createDataFrame([(c,) for c in text], "column string").join(F.broadcast(counted), "column", "left")  # a row for each column
        metric = lambda m, v: F.struct(F.lit("categorical").alias("section"), F.col("column"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
        parts.append(known.select(each([metric("n_unique", F.coalesce("n_unique", F.lit(0))), metric("mode_count", F.col("mode_count"))])))
    parts.append(duplicate_rows(df).select(each([row("table", "", "n_duplicates", F.col("n_duplicates"))])))
    return reduce(DataFrame.union, parts).select("m.section", "m.column", "m.metric", F.round("m.value", digits).alias("value"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """n_classes, minority, n_rows (nulls too), ratio and severity of a target."""
    counts = df.groupBy(name(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.count("c").alias("n_classes"), F.min(F.when(F.col("c").isNotNull(), F.col("n"))).alias("minority"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    ratio = F.try_divide(F.col("minority"), F.col("n_rows"))
    severity = F.when(ratio < 0.05, "extreme").when(ratio < 0.2, "severe").when(ratio < 0.4, "mild").otherwise("balanced")
    return out.select("n_classes", "minority", "n_rows", F.round(ratio, 3).alias("ratio"), severity.alias("severity"))


def group_aggregate(df: DataFrame, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[a.alias(k) for k, a in aggregates.items()])
