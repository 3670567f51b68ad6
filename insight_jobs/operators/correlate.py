"""Pearson correlations of numeric columns from moments of one scan."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from .moments import pearson_pairs, rounded
from .profile import numeric_columns, one_pass, value

MULTICOLLINEAR, LOW_VARIANCE = 0.85, 0.01
STRENGTHS = ((0.85, "very strong"), (0.70, "strong"), (0.50, "moderate"), (0.30, "weak"))


def strength(r: Column) -> Column:
    out = F.when(r >= STRENGTHS[0][0], STRENGTHS[0][1])
    for least, label in STRENGTHS[1:]:
        out = out.when(r >= least, label)
    return out.otherwise("negligible")


def pearson(a: Column, b: Column) -> Column:
    """r over the rows that have both; null where either is constant there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # partial sums of a constant need not cancel
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, batch: int = 300) -> DataFrame:
    """col1, col2, r (3 digits), each pair once in column order.

    One scan gives all pairs. Those whose values nearly cancelled, or that hold infinities, are computed again by Spark's
    own aggregates, `batch` at a time, so that generated code keeps a size that compiles.
    """
    names = columns or numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, r double")
    found = shared.written(pearson_pairs(df, names), shared.fresh_dir(df.sparkSession, "pairs"))
    open_ = [(names[r["at"]], names[r["other"]]) for r in found.where("NOT sure").select("at", "other").collect()]  # pairs of columns
    known = F.array(*map(F.lit, names))
    out = found.where("sure").select(F.get(known, F.col("at")).alias("col1"), F.get(known, F.col("other")).alias("col2"), "r")
    for start in range(0, len(open_), batch):
        out = out.union(aggregated_pairs(df, open_[start : start + batch]))
    missing = list(combinations(names, 2)) if found.isEmpty() else []  # an empty table has no rows to send
    return df.sparkSession.createDataFrame([(a, b, None) for a, b in missing], "col1 string, col2 string, r double") if missing else out


def aggregated_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    wide = df.agg(*[pearson(value(a), value(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), rounded(F.col(f"r{k}")).alias("r")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and one column of r for each of the columns; 1 on the diagonal."""
    columns = columns or numeric_columns(df)
    pairs = correlation_pairs(df, columns)
    both = pairs.union(pairs.select("col2", "col1", "r")).union(df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col1 string, col2 string, r double"))
    return both.groupBy(F.col("col1").alias("column")).pivot("col2", columns).agg(F.first("r"))


def with_strength(pairs: DataFrame) -> DataFrame:
    return pairs.where("r IS NOT NULL").withColumn("abs_r", F.abs("r")).withColumn("strength", strength(F.col("abs_r")))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return with_strength(pairs).orderBy(F.desc("abs_r"), "col1", "col2").limit(n)


def multicollinear_pairs(pairs: DataFrame, threshold: float = MULTICOLLINEAR) -> DataFrame:
    return with_strength(pairs).where(F.col("abs_r") >= threshold)


def low_variance_columns(df: DataFrame, threshold: float = LOW_VARIANCE) -> DataFrame:
    return one_pass(df, numeric_columns(df), {"v": lambda c: F.var_samp(value(c))}).where(F.col("v") < threshold).select("column", F.round("v", 6).alias("variance"))


def target_correlation(pairs: DataFrame, target: str) -> DataFrame:
    """column, r, abs_r, strength of every other column with the target."""
    mine = pairs.where((F.col("col1") == target) | (F.col("col2") == target))
    return with_strength(mine).select(F.when(F.col("col1") == target, F.col("col2")).otherwise(F.col("col1")).alias("column"), "r", "abs_r", "strength")


def correlation_digest(pairs: DataFrame, low: DataFrame, target: str, n: int = 3) -> DataFrame:
    """One line of text: strongest pairs, multicollinear pairs, low-variance columns, best predictors."""

    def listed(rows: DataFrame, text: Column, order: list[Column], head: str) -> DataFrame:
        ranked = rows.select(text.alias("t"), F.row_number().over(Window.orderBy(*order)).alias("k")).where(F.col("k") <= n)  # a row for each pair of columns
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ", ")
        return ranked.agg(F.when(F.count("t") > 0, F.concat(F.lit(head), joined)).alias("line"))

    strong = with_strength(pairs)
    pair = F.concat(F.col("col1"), F.lit(" ~ "), F.col("col2"), F.lit(" (r="), F.format_number("r", 3), F.lit(")"))
    by_r = [F.desc("abs_r"), F.col("col1"), F.col("col2")]
    parts = [
        listed(strong, pair, by_r, "Top correlations: "),
        listed(strong.where(F.col("abs_r") >= MULTICOLLINEAR), pair, by_r, "Multicollinear: "),
        listed(low, F.col("column"), [F.col("column")], "Low variance: "),
        listed(target_correlation(pairs, target), F.concat(F.col("column"), F.lit(" (r="), F.format_number("r", 3), F.lit(")")), [F.desc("abs_r"), F.col("column")], f"Top predictors of {target}: "),
    ]
    lines = None
    for k, part in enumerate(parts):
        row = part.select(F.lit(k).alias("k"), "line")
        lines = row if lines is None else lines.union(row)
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), ". ").alias("digest"))
