"""Queries of the table operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, correlate, filters, profile, quantiles
from .registry import query, table

LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VALUES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, d):
    return table(spark, d, "lineitem")


def lines_with_nulls(spark, d):
    """lineitem with nulls in l_tax and l_returnflag."""
    return lines(spark, d).withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0))).withColumn("l_returnflag", F.nullif(F.col("l_returnflag"), F.lit("R")))


NULLED = "(SELECT * REPLACE (nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)"


def union_sql(columns, template):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(
    "SELECT n.n_rows, 7::BIGINT AS n_columns, t.position, t.\"column\", t.dtype FROM (SELECT count(*) AS n_rows FROM orders) n, "
    "(VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), "
    "(4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'), (6, 'flag', 'int')) t(position, \"column\", dtype)"
)
def table_shape(spark, d):
    keep = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return profile.table_shape(table(spark, d, "orders").select(*keep, F.lit(1).alias("flag")))


@query(union_sql([*LINE_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"], "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_nulls FROM " + NULLED))
def null_counts(spark, d):
    return profile.null_counts(lines_with_nulls(spark, d).select(*LINE_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"))


@query(union_sql(
    LINE_NUMERIC,
    "SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS min, "
    "round(quantile_cont({c}::DOUBLE, 0.25), 3) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 3) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 3) AS q75, "
    "round(max({c})::DOUBLE, 3) AS max FROM " + NULLED,
))
def numeric_summary(spark, d):
    return profile.numeric_summary(lines_with_nulls(spark, d))


@query(union_sql(
    VALUES,
    "SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 2) AS median, round(stddev_samp({c}), 2) AS std, "
    "round(CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END, 2) AS skew FROM " + NULLED,
))
def column_stats(spark, d):
    return profile.column_stats(lines_with_nulls(spark, d).select(*VALUES))


@query(union_sql(LINE_NUMERIC, "SELECT * FROM (SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, list_sort(list(DISTINCT {c}::DOUBLE)) AS \"values\" FROM lineitem) WHERE n_unique <= 15"))
def discrete_columns(spark, d):
    return profile.discrete_columns(lines(spark, d))


VALUE_COUNTS = "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"


@query(union_sql(["l_returnflag", "l_linestatus", "l_linenumber"], VALUE_COUNTS.replace("{t}", NULLED)))
def value_counts(spark, d):
    return profile.value_counts(lines_with_nulls(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(union_sql(
    ["l_returnflag", "l_linestatus"],
    "SELECT '{c}' AS \"column\", n_unique, mode, mode_count, n_nulls FROM (SELECT count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_nulls FROM " + NULLED + "), "
    "(SELECT {c} AS mode, count(*) AS mode_count FROM " + NULLED + " WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
))
def categorical_summary(spark, d):
    return profile.categorical_summary(lines_with_nulls(spark, d), ["l_returnflag", "l_linestatus"])


DUPES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]


@query(f"SELECT sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(DUPES)})")
def duplicate_rows(spark, d):
    return profile.duplicate_rows(lines(spark, d).select(*DUPES))


def _profile_sql() -> str:
    numeric = "SELECT 'numeric' AS section, '{c}' AS \"column\", unnest(['mean','std','min','max','median','nulls']) AS metric, unnest([avg({c}), stddev_samp({c}), min({c})::DOUBLE, max({c})::DOUBLE, quantile_cont({c}::DOUBLE, 0.5), (count(*) - count({c}))::DOUBLE]) AS value FROM t"
    text = "SELECT 'categorical', '{c}', unnest(['n_unique','mode_count','n_nulls']), unnest([(SELECT count(DISTINCT {c}) FROM t)::DOUBLE, (SELECT count(*) FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)::DOUBLE, (SELECT count(*) - count({c}) FROM t)::DOUBLE])"
    dupes = ", ".join([*VALUES, "l_returnflag", "l_linestatus"])
    nulls = " + ".join(f"(count(*) - count({c}))" for c in [*VALUES, "l_returnflag", "l_linestatus"])
    parts = ["SELECT 'shape' AS section, '' AS \"column\", unnest(['n_rows','n_columns']) AS metric, unnest([count(*)::DOUBLE, 7.0::DOUBLE]) AS value FROM t", union_sql(VALUES, numeric), union_sql(["l_returnflag", "l_linestatus"], text), f"SELECT 'table', '', 'null_total', ({nulls})::DOUBLE FROM t", f"SELECT 'table', '', 'n_duplicates', sum(n - 1)::DOUBLE FROM (SELECT count(*) AS n FROM t GROUP BY {dupes})"]
    return f"WITH t AS {NULLED} SELECT section, \"column\", metric, round(value, 3) AS value FROM ({' UNION ALL '.join(parts)})"


@query(_profile_sql())
def stat_profile(spark, d):
    return profile.stat_profile(lines_with_nulls(spark, d).select(*VALUES, "l_returnflag", "l_linestatus"))


@query(union_sql(["c_custkey", "c_name"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM customer HAVING count(DISTINCT {c}) = count(*)"))
def id_like_columns(spark, d):
    return profile.id_like_columns(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query(union_sql(["l_returnflag", "l_quantity", "l_linestatus"], "SELECT '{c}' AS \"column\", v AS value, position FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS position FROM " + NULLED + " WHERE {c} IS NOT NULL) WHERE position <= 3"))
def column_samples(spark, d):
    return profile.column_samples(lines_with_nulls(spark, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3, ["l_returnflag", "l_quantity", "l_linestatus"])


PAIRS = [(a, b) for i, a in enumerate(VALUES) for b in VALUES[i + 1 :]]
PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 3) AS r FROM {NULLED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)
STRENGTH_SQL = "CASE WHEN abs(r) >= 0.85 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength"


def pairs(spark, d):
    return correlate.correlation_pairs(lines_with_nulls(spark, d), VALUES)


def _matrix_sql() -> str:
    cells = ", ".join(f"max(r) FILTER (col2 = '{c}') AS {c}" for c in VALUES)
    same = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in VALUES)
    return f"WITH p AS ({PAIRS_SQL}), q AS (SELECT * FROM p UNION ALL SELECT col2, col1, r FROM p UNION ALL {same}) SELECT col1 AS \"column\", {cells} FROM q GROUP BY 1"


@query(_matrix_sql())
def correlation_matrix(spark, d):
    return correlate.correlation_matrix(lines_with_nulls(spark, d), VALUES)


@query(f"SELECT col1, col2, r, abs(r) AS abs_r, {STRENGTH_SQL} FROM ({PAIRS_SQL}) WHERE r IS NOT NULL ORDER BY abs_r DESC, col1, col2 LIMIT 10")
def top_pairs(spark, d):
    return correlate.top_pairs(pairs(spark, d))


@query(f"SELECT col1, col2, r, abs(r) AS abs_r, {STRENGTH_SQL} FROM ({PAIRS_SQL}) WHERE abs(r) >= 0.85")
def multicollinear_pairs(spark, d):
    return correlate.multicollinear_pairs(pairs(spark, d))


@query("SELECT * FROM (SELECT 'l_discount' AS \"column\", round(var_samp(l_discount), 6) AS variance FROM lineitem UNION ALL SELECT 'l_tax', round(var_samp(l_tax), 6) FROM lineitem UNION ALL SELECT 'fixed', 0.0) WHERE variance < 0.01")
def low_variance_columns(spark, d):
    return correlate.low_variance_columns(lines(spark, d).withColumn("fixed", F.lit(1.5)))


@query(f"SELECT CASE WHEN col1 = 'l_extendedprice' THEN col2 ELSE col1 END AS \"column\", r, abs(r) AS abs_r, {STRENGTH_SQL} FROM ({PAIRS_SQL}) WHERE (col1 = 'l_extendedprice' OR col2 = 'l_extendedprice') AND r IS NOT NULL")
def target_correlation(spark, d):
    return correlate.target_correlation(pairs(spark, d), "l_extendedprice")


def _digest_sql() -> str:
    pair = "col1 || ' ~ ' || col2 || ' (r=' || format('{:.3f}', r) || ')'"
    mine = "(SELECT CASE WHEN col1 = 'l_extendedprice' THEN col2 ELSE col1 END AS c, r FROM p WHERE (col1 = 'l_extendedprice' OR col2 = 'l_extendedprice') AND r IS NOT NULL)"
    line = "(SELECT '{h}' || string_agg(t, ', ' ORDER BY {o}) FROM (SELECT {t} AS t, * FROM {f} ORDER BY {o} LIMIT 3))"
    lines_ = [line.format(h="Top correlations: ", t=pair, f="(SELECT * FROM p WHERE r IS NOT NULL)", o="abs(r) DESC, col1, col2"), line.format(h="Multicollinear: ", t=pair, f="(SELECT * FROM p WHERE abs(r) >= 0.85)", o="abs(r) DESC, col1, col2"), line.format(h="Low variance: ", t="c", f="(SELECT 'l_discount' AS c UNION ALL SELECT 'l_tax')", o="c"), line.format(h="Top predictors of l_extendedprice: ", t="c || ' (r=' || format('{:.3f}', r) || ')'", f=mine, o="abs(r) DESC, c")]
    return f"WITH p AS ({PAIRS_SQL}) SELECT concat_ws('. ', {', '.join(lines_)}) AS digest"


@query(_digest_sql())
def correlation_digest(spark, d):
    low = correlate.low_variance_columns(lines_with_nulls(spark, d).select(*VALUES))
    return correlate.correlation_digest(pairs(spark, d), low, "l_extendedprice")


@query("SELECT *, CASE WHEN ratio0 < 0.05 THEN 'extreme' WHEN ratio0 < 0.2 THEN 'severe' WHEN ratio0 < 0.4 THEN 'mild' ELSE 'balanced' END AS severity FROM (SELECT count(c) AS n_classes, min(n) FILTER (c IS NOT NULL) AS minority, sum(n)::BIGINT AS n_rows, round(min(n) FILTER (c IS NOT NULL) / sum(n), 3) AS ratio, min(n) FILTER (c IS NOT NULL) / sum(n) AS ratio0 FROM (SELECT toxic AS c, count(*) AS n FROM labels GROUP BY 1))".replace("SELECT *, CASE", "SELECT n_classes, minority, n_rows, ratio, CASE", 1))
def class_balance(spark, d):
    return profile.class_balance(table(spark, d, "labels"), "toxic")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL")
def group_aggregate(spark, d):
    return profile.group_aggregate(lines(spark, d), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 2), "price": F.round(F.avg("l_extendedprice"), 4)})


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(p_type), '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 30")
def word_counts(spark, d):
    return charts.word_counts(table(spark, d, "part"), "p_type", 30)


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
KEYS_SQL = ", ".join(KEYS)


@query(f"SELECT {KEYS_SQL} FROM lineitem WHERE l_quantity = 7")
def filter_eq(spark, d):
    return filters.filter_eq(lines(spark, d), "l_quantity", 7.0).select(*KEYS)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq_text(spark, d):
    return filters.filter_eq_text(table(spark, d, "customer"), "c_mktsegment", "Building").select("c_custkey", "c_name", "c_mktsegment")


@query(f"SELECT {KEYS_SQL} FROM lineitem WHERE l_extendedprice > 50000")
def filter_gt(spark, d):
    return filters.filter_gt(lines(spark, d), "l_extendedprice", 50000.0).select(*KEYS)


@query(f"SELECT {KEYS_SQL} FROM lineitem WHERE l_quantity < 3")
def filter_lt(spark, d):
    return filters.filter_lt(lines(spark, d), "l_quantity", 3.0).select(*KEYS)


@query(f"SELECT {KEYS_SQL} FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_between(spark, d):
    return filters.filter_between(lines(spark, d), "l_quantity", 10.0, 12.0).select(*KEYS)


@query(f"SELECT {KEYS_SQL}, l_tax, l_returnflag FROM {NULLED} WHERE l_tax IS NULL OR l_returnflag IS NULL")
def filter_any_null(spark, d):
    return filters.filter_any_null(lines_with_nulls(spark, d)).select(*KEYS, "l_tax", "l_returnflag")


@query(f"SELECT {KEYS_SQL}, l_tax FROM {NULLED} WHERE l_tax IS NOT NULL")
def filter_not_null(spark, d):
    return filters.filter_not_null(lines_with_nulls(spark, d), "l_tax").select(*KEYS, "l_tax")


@query(f"SELECT {KEYS_SQL}, l_returnflag FROM lineitem WHERE l_quantity > 40 AND lower(l_returnflag) = 'r' AND l_discount BETWEEN 0.05 AND 0.07")
def filter_spec(spark, d):
    specs = [filters.FilterSpec("l_quantity", "gt", 40.0), filters.FilterSpec("l_returnflag", "eq_text", "R"), filters.FilterSpec("l_discount", "between", (0.05, 0.07))]
    return filters.filter_spec(lines(spark, d), specs).select(*KEYS, "l_returnflag")


@query(f"SELECT {KEYS_SQL} FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def top_n(spark, d):
    return filters.top_n(lines(spark, d), "l_extendedprice", 25, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select(*KEYS)


@query(f"SELECT {KEYS_SQL}, l_tax FROM {NULLED} ORDER BY l_tax ASC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 25")
def bottom_n(spark, d):
    return filters.bottom_n(lines_with_nulls(spark, d), "l_tax", 25, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select(*KEYS, "l_tax")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n_rows FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 20")
def head(spark, d):
    return filters.head(filters.filter_gt(table(spark, d, "customer"), "c_acctbal", 0.0), 20, ["c_custkey"]).select("c_custkey", "c_name", "n_rows")


@query("SELECT c_custkey, c_nationkey FROM customer")
def select_columns(spark, d):
    return filters.select_columns(table(spark, d, "customer"), "key$")


#: Sentences of every filter rule; {} is a part's name, which no column has.
SENTENCES = ["Show rows where p_size is 10?", "filter where p_brand equals 'Brand#1'", "list parts with p_size > 30", "p_retailprice more than 1200.5 please", "rows with p_size below 5", "top 12 by p_retailprice", "show the missing values", "tell me about {}", "where colour is {} and p_size above 40"]


def sentences(spark, d):
    text = F.replace(F.get(F.array(*[F.lit(s) for s in SENTENCES]), F.pmod("p_partkey", F.lit(len(SENTENCES))).cast("int")), F.lit("{}"), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), text.alias("text"))


SENTENCES_SQL = "SELECT p_partkey AS question_id, replace([" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + f"][(p_partkey % {len(SENTENCES)} + 1)::INT], '{{}}', p_name) AS text FROM part"
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _parse_sql() -> str:
    known = "[" + ", ".join(f"'{c}'" for c in PART_COLUMNS) + "]"
    col = lambda p, k: f"list_extract(list_filter({known}, lambda x: x = regexp_extract(q, '{p}', {k})), 1)"
    eq, gt, lt, top = (x.replace("(?U)", "") for x in (filters.EQ, filters.GT, filters.LT, filters.TOP))
    val = f"trim(rtrim(trim(regexp_extract(q, '{eq}', 2), '''\".,'), '?'), '')"
    return (
        f"WITH s AS ({SENTENCES_SQL}), t AS (SELECT *, lower(trim(text)) AS q FROM s), c AS (SELECT *, {col(eq, 1)} AS c1, {val} AS v1, {col(gt, 1)} AS c2, regexp_extract(q, '{gt}', 2) AS v2, {col(lt, 1)} AS c3, regexp_extract(q, '{lt}', 2) AS v3, {col(top, 2)} AS c4, regexp_extract(q, '{top}', 1) AS v4, regexp_matches(q, 'missing|null|na values|empty') AS m FROM t) "
        "SELECT question_id, text, CASE WHEN c1 IS NOT NULL THEN CASE WHEN try_cast(v1 AS DOUBLE) IS NOT NULL THEN 'eq' ELSE 'eq_text' END WHEN c2 IS NOT NULL THEN 'gt' WHEN c3 IS NOT NULL THEN 'lt' WHEN c4 IS NOT NULL THEN 'top_n' WHEN m THEN 'any_null' END AS op, "
        "coalesce(c1, c2, c3, c4) AS \"column\", CASE WHEN c1 IS NOT NULL THEN v1 WHEN c2 IS NOT NULL THEN v2 WHEN c3 IS NOT NULL THEN v3 WHEN c4 IS NOT NULL THEN v4 END AS value FROM c"
    )


@query(_parse_sql())
def parse_filter(spark, d):
    return filters.parse_filter(sentences(spark, d), PART_COLUMNS)


@query("WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30))::INT + 1, 30) AS bin, count(*) AS n FROM lineitem, l GROUP BY 1) SELECT b.bin::INT AS bin, round(lo + (b.bin - 1) * ((hi - lo) / 30), 4) AS low, round(lo + b.bin * ((hi - lo) / 30), 4) AS high, coalesce(n, 0) AS n FROM l, range(1, 31) b(bin) LEFT JOIN c ON c.bin = b.bin")
def histogram(spark, d):
    return charts.histogram(lines(spark, d), "l_extendedprice")


@query("SELECT * FROM (SELECT 'l_partkey' AS \"column\", l_partkey::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey::VARCHAR)::INT AS rank FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 2) WHERE rank <= 20")
def top_values(spark, d):
    return profile.value_counts(lines(spark, d), ["l_partkey"], 20)


@query("SELECT value, n, row_number() OVER (ORDER BY n DESC, value)::INT AS rank FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)")
def bar_counts(spark, d):
    return charts.bar_counts(table(spark, d, "events"), "event_type")


@query("SELECT 'event_type' AS \"column\", 'bar' AS kind, event_type AS label, count(*) AS n FROM events GROUP BY 3 UNION ALL SELECT 'value', 'histogram', b.bin::VARCHAR, coalesce(n, 0) FROM range(1, 31) b(bin) LEFT JOIN (SELECT least(floor((value - lo) / ((hi - lo) / 30))::INT + 1, 30) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1) c ON c.bin = b.bin")
def auto_distribution(spark, d):
    return charts.auto_distribution(table(spark, d, "events").select("event_type", "value"))


@query("SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def scatter_points(spark, d):
    return charts.scatter_points(lines(spark, d), "l_quantity", "l_extendedprice", "l_returnflag")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def pair_points(spark, d):
    return charts.pair_points(lines(spark, d))


@query("WITH b AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) SELECT g AS \"group\", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)), 4) AS low, round(max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)), 4) AS high, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM lineitem JOIN b ON g = l_returnflag GROUP BY g, q1, median, q3")
def box_stats(spark, d):
    return charts.box_stats(lines(spark, d), "l_extendedprice", "l_returnflag")


@query("SELECT 'l_quantity' AS \"column\", l_returnflag, unnest([0.25, 0.5, 0.9])::DOUBLE AS share, unnest(list_transform(quantile_cont(l_quantity, [0.25, 0.5, 0.9]), lambda v: round(v, 6))) AS value FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_extendedprice' AS \"column\", l_returnflag, unnest([0.25, 0.5, 0.9])::DOUBLE AS share, unnest(list_transform(quantile_cont(l_extendedprice, [0.25, 0.5, 0.9]), lambda v: round(v, 6))) AS value FROM lineitem GROUP BY 2")
def exact_quantiles(spark, d):
    """Quantiles within groups by selection."""
    return quantiles.exact_quantiles(lines(spark, d), ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.9], ["l_returnflag"]).withColumn("value", F.round("value", 6))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1")
def pie_shares(spark, d):
    return charts.pie_shares(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def line_series(spark, d):
    return charts.line_series(table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM"), F.round(F.sum("o_totalprice"), 2))


@query("WITH r AS (SELECT p_brand AS result_set, CASE WHEN p_partkey % 50 = 0 THEN 'model_a' ELSE p_type END AS model, p_size / 50.0 AS accuracy, p_retailprice / 2000 AS cv FROM part) SELECT result_set, model, metric, score FROM (SELECT result_set, model, unnest(['accuracy', 'cv']) AS metric, unnest([accuracy::DOUBLE, cv::DOUBLE]) AS score FROM r WHERE result_set NOT IN (SELECT result_set FROM r WHERE regexp_matches(lower(model), '^model[\\s_\\-]?[a-z0-9]$'))) WHERE score IS NOT NULL")
def model_comparison_long(spark, d):
    part = table(spark, d, "part")
    model = F.when(F.col("p_partkey") % 50 == 0, "model_a").otherwise(F.col("p_type"))
    results = part.select(F.col("p_brand").alias("result_set"), model.alias("model"), (F.col("p_size") / 50.0).alias("accuracy"), (F.col("p_retailprice") / 2000).alias("cv"))
    return charts.model_comparison_long(results, ["accuracy", "cv"])
