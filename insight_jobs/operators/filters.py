"""Row filters, top-k and the structured form of filter sentences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import is_missing, name


@dataclass(frozen=True)
class FilterSpec:
    """op: eq, eq_text, gt, lt, between (value: a pair), not_null, is_null."""

    column: str
    op: str
    value: object = None


def condition(df: DataFrame, spec: FilterSpec) -> Column:
    c = name(spec.column)
    if spec.op == "eq_text":
        return F.lower(c.cast("string")) == F.lower(F.lit(str(spec.value)))
    if spec.op == "between":
        return c.between(*spec.value)
    if spec.op in ("not_null", "is_null"):
        missing = is_missing(df, spec.column)
        return ~missing if spec.op == "not_null" else missing
    return {"eq": c == spec.value, "gt": c > spec.value, "lt": c < spec.value}[spec.op]


def filter_spec(df: DataFrame, specs: list[FilterSpec]) -> DataFrame:
    """Rows that meet all specs."""
    return df.where(reduce(and_, [condition(df, s) for s in specs])) if specs else df


def filter_eq(df: DataFrame, column: str, number: float) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "eq", number)])


def filter_eq_text(df: DataFrame, column: str, text: str) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "eq_text", text)])


def filter_gt(df: DataFrame, column: str, number: float) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "gt", number)])


def filter_lt(df: DataFrame, column: str, number: float) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "lt", number)])


def filter_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "between", (low, high))])


def filter_any_null(df: DataFrame) -> DataFrame:
    return df.where(reduce(or_, [is_missing(df, c) for c in df.columns]))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return filter_spec(df, [FilterSpec(column, "not_null")])


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""
    return F.when(~is_missing(df, column), name(column))


def top_n(df: DataFrame, column: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(present(df, column).desc_nulls_last(), *tie).limit(n)


def bottom_n(df: DataFrame, column: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(present(df, column).asc_nulls_last(), *tie).limit(n)


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows with the number of all."""
    return df.orderBy(*order_by).limit(n).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))  # one row


def select_columns(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose name matches the pattern; none is an error."""
    import re

    found = [c for c in df.columns if re.search(pattern, c)]
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return df.select(*[name(c) for c in found])


# Patterns of filter sentences, in the order in which they are tried.
EQ = r"(?U)where\s+(\w+)\s+(?:is|==|=|equals?)\s+(\S+)"
GT = r"(?U)(\w+)\s*(?:>|greater than|more than|above|over)\s*(\d+\.?\d*)"
LT = r"(?U)(\w+)\s*(?:<|less than|below|under)\s*(\d+\.?\d*)"
TOP = r"(?U)top\s+(\d+)\s+(?:by|based on|sorted by)?\s*(\w+)"
MISSING = r"missing|null|na values|empty"
# End of the fixed values.


def parse_filter(questions: DataFrame, columns: list[str]) -> DataFrame:
    """Add op, column, value (text) to questions (text): the first rule that matches a known column."""
    known = F.create_map(*[x for c in columns for x in (F.lit(c.lower()), F.lit(c))])
    q = F.lower(F.trim("text"))
    part = lambda pattern, k: F.regexp_extract(q, pattern, k)
    column = lambda pattern, k: F.try_element_at(known, part(pattern, k))
    eq_value = F.regexp_replace(F.regexp_replace(part(EQ, 2), "^['\".,]+|['\".,]+$", ""), r"\?+$", "")
    spec = lambda op, c, v: F.struct(F.lit(op).alias("op"), c.alias("column"), v.alias("value"))
    rules = [
        F.when(column(EQ, 1).isNotNull(), F.when(eq_value.try_cast("double").isNotNull(), spec("eq", column(EQ, 1), eq_value)).otherwise(spec("eq_text", column(EQ, 1), F.lower(eq_value)))),
        F.when(column(GT, 1).isNotNull(), spec("gt", column(GT, 1), part(GT, 2))),
        F.when(column(LT, 1).isNotNull(), spec("lt", column(LT, 1), part(LT, 2))),
        F.when(column(TOP, 2).isNotNull(), spec("top_n", column(TOP, 2), part(TOP, 1))),
        F.when(q.rlike(MISSING), spec("any_null", F.lit(None).cast("string"), F.lit(None).cast("string"))),
    ]
    return questions.withColumn("s", F.coalesce(*rules)).select("*", "s.op", "s.column", "s.value").drop("s")
