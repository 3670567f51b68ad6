"""Exact quantiles by selection: rounds of mergeable sketches narrow each rank's range, then the value is picked.

A round is one pass that is summed before it is shuffled: for each group and rank it counts what lies under, at and between
the ends of a range, and sketches what lies between by a grid of approximate quantiles of bounded size and error. The next
range is the two grid values around the rank, which holds a small share of the last one, or one value alone where that
has the rank, so that many copies of a value end it. When each range surely holds few values between its ends, a last
pass picks from these. Nothing holds all distinct values, whatever the group.
"""

from __future__ import annotations

from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import shared
from .profile import name, value

GRID, ACCURACY, PICKED = 500, 5_000, 10_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] = (), picked: int = PICKED, grid: int = GRID) -> DataFrame:
    """by, column, share, value: interpolated quantiles of numeric columns within groups; null of no values.

    Nulls and NaN are left out; null is a group of its own. picked: so many values of a range are looked at one by one.
    """
    spark, by = df.sparkSession, list(by)
    if not columns:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return spark.createDataFrame([], T.StructType([*[T.StructField(b, kinds[b]) for b in by], T.StructField("column", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("value", T.DoubleType())]))
    keys = [f"g{k}" for k in range(len(by))]
    x = [f"x{k}" for k in range(len(columns))]
    rows = df.select(*[name(b).alias(g) for b, g in zip(by, keys, strict=True)], *[value(c).alias(v) for c, v in zip(columns, x, strict=True)])
    steps = [k / grid for k in range(grid + 1)]

    # First pass: one sketch a column and group serves all its ranks.
    ends = rows.groupBy(*keys).agg(*[e for v in x for e in (F.count(v).alias(f"n_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), F.percentile_approx(v, steps, ACCURACY).alias(f"q_{v}"))])
    asked = [(v, s) for v in x for s in shares]
    targets = []
    for v, s in asked:
        n = F.col(f"n_{v}")
        rank = F.floor(F.lit(float(s)) * (n - 1)).cast("long")
        low, high = around(F.col(f"q_{v}"), F.try_divide(rank.cast("double"), n), F.col(f"min_{v}"), F.col(f"max_{v}"), grid)
        targets.append(target(len(targets), rank, low, high, n, between_at_most(n, grid)))
    place = shared.fresh_dir(spark, "quantiles")
    state = shared.written(ends.select(*keys, *targets), f"{place}/0")
    for turn in range(1, 64):
        if (state.agg(F.max(F.greatest(F.lit(0), *[F.col(f"t{k}.most") for k in range(len(asked))]))).first()[0] or 0) <= picked:
            break
        aggs = []
        for k, (v, _) in enumerate(asked):
            between = inside(f"t{k}", v)
            aggs += [F.first(f"t{k}").alias(f"t{k}"), F.count_if(F.col(v) < F.col(f"t{k}.low")).alias(f"below{k}"), F.count_if(F.col(v) == F.col(f"t{k}.low")).alias(f"least{k}"), F.count_if(between).alias(f"between{k}"), F.percentile_approx(F.when(between, F.col(v)), steps, ACCURACY).alias(f"q{k}")]
        counted = shared.written(joined(rows, state, keys).groupBy(*keys).agg(*aggs), f"{place}/{turn}-counts")
        targets = []
        for k in range(len(asked)):
            t, between = F.col(f"t{k}"), F.col(f"between{k}")
            rest = t["rank"] - F.col(f"below{k}")
            deep = rest - F.col(f"least{k}")
            low, high = around(F.col(f"q{k}"), F.try_divide(deep.cast("double"), between), t["low"], t["high"], grid)
            at_low, at_high, few = rest < F.col(f"least{k}"), deep >= between, between <= picked
            new_low = F.when(at_low | few, t["low"]).when(at_high, t["high"]).otherwise(low)
            new_high = F.when(at_low, t["low"]).when(at_high | few, t["high"]).otherwise(high)
            most = F.when(at_low | at_high, F.lit(0).cast("long")).when(few, between).otherwise(F.least(between, between_at_most(between, grid)))
            targets.append(target(k, t["rank"], new_low, new_high, t["n"], most))
        state = shared.written(counted.select(*keys, *targets), f"{place}/{turn}")
    aggs = []
    for k, (v, _) in enumerate(asked):
        c, t = F.col(v), f"t{k}"
        low, high = F.col(f"{t}.low"), F.col(f"{t}.high")
        few = F.sort_array(F.collect_list(F.when(inside(t, v), c)))  # `picked` values at most
        aggs.append(F.struct(F.first(t).alias("t"), F.count_if(c < low).alias("below"), F.count_if(c == low).alias("least"), few.alias("few"), F.count_if((c == high) & (low < high)).alias("most"), F.min(F.when(c > high, c)).alias("over")).alias(f"p{k}"))
    values = joined(rows, state, keys).groupBy(*keys).agg(*aggs)
    out = []
    for k, (v, s) in enumerate(asked):
        p = F.col(f"p{k}")
        at = F.lit(float(s)) * (p["t"]["n"] - 1)
        low, high = picked_at(p, 0), picked_at(p, 1)
        share = at - F.floor(at)
        out.append(F.struct(F.lit(columns[x.index(v)]).alias("column"), F.lit(float(s)).alias("share"), F.when(share == 0, low).otherwise(low + (high - low) * share).alias("value")))
    done = values.select(*[F.col(g).alias(b) for g, b in zip(keys, by, strict=True)], F.explode(F.array(*out)).alias("r")).select(*[name(b) for b in by], "r.*")
    done = shared.written(done, shared.fresh_dir(spark, "result"))
    shared.delete(spark, place)
    return done


def counted_quantiles(df: DataFrame, columns: list[str], shares: list[float], parts: int = 64) -> DataFrame:
    """column, share, value as exact_quantiles has them, for many columns and no groups; a column without values has no rows.

    Values are counted by hash, and the counts dealt into ranges of their order: sums of the ranges tell which of them hold a
    rank, and only these are numbered. Fewer scans than by selection, for a shuffle of the distinct values.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("c"), value(v).alias("x")) for k, v in enumerate(columns)])
    counts = df.select(F.explode(pairs).alias("p")).select("p.c", "p.x").where("x IS NOT NULL").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
    dealt = shared.written(counts.repartitionByRange(parts, "c", "x").withColumn("part", F.spark_partition_id()), shared.fresh_dir(df.sparkSession, "counts"))
    every = Window.partitionBy("c")  # `parts` rows a column
    sizes = dealt.groupBy("c", "part").agg(F.sum("n").alias("rows"))
    sizes = sizes.select("c", "part", "rows", F.coalesce(F.sum("rows").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(every).alias("total"))
    asked = sizes.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.col("share") * (F.col("total") - 1))
    asked = asked.select("*", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("pos")).where("before <= pos AND pos < before + rows").select("c", "part", "before", "share", "at", "pos")
    held = dealt.join(F.broadcast(asked.select("c", "part", "before").distinct()), ["c", "part"])  # two rows a column and share at most
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("c", "part").orderBy("x"))
    found = held.withColumn("upto", upto).drop("before").join(F.broadcast(asked.drop("before")), ["c", "part"]).where("pos < upto AND pos >= upto - n")
    rest = F.col("at") - F.floor("at")
    ends = found.groupBy("c", "share", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    named = F.get(F.array(*[F.lit(c) for c in columns]), F.col("c"))
    return ends.select(named.alias("column"), "share", F.when(rest == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * rest).alias("value"))


def target(k: int, rank: Column, low: Column, high: Column, n: Column, most: Column) -> Column:
    """A rank's range: `most` is how many values lie between its ends at most."""
    alone = (low == high) | low.isNull()
    return F.struct(rank.alias("rank"), low.alias("low"), high.alias("high"), n.alias("n"), F.when(alone, F.lit(0).cast("long")).otherwise(most.cast("long")).alias("most")).alias(f"t{k}")


def between_at_most(n: Column, grid: int) -> Column:
    """How many of n values lie between the grid values that `around` takes, by the sketch's error."""
    return F.ceil(n * ((2 * slack(grid) + 1) / grid + 2 / ACCURACY)).cast("long")


def slack(grid: int) -> int:
    return 1 + ceil(grid / ACCURACY)


def picked_at(p: Column, further: int) -> Column:
    """The value of the rank, or the next one: the low end's copies, the few between, the high end's copies, the first beyond."""
    at = p["t"]["rank"] - p["below"] + further
    deep = at - p["least"]
    between = F.size(p["few"])
    return F.when(at < p["least"], p["t"]["low"]).when(deep < between, F.get(p["few"], deep.cast("int"))).when(deep - between < p["most"], p["t"]["high"]).otherwise(p["over"])


def inside(t: str, v: str) -> Column:
    return (F.col(v) > F.col(f"{t}.low")) & (F.col(v) < F.col(f"{t}.high"))


def around(grid_values: Column, share: Column, low: Column, high: Column, grid: int) -> tuple[Column, Column]:
    """The grid values that surely enclose a rank's share, or the ends of the range beyond the grid."""
    below, over = F.floor(share * grid).cast("int") - slack(grid), F.ceil(share * grid).cast("int") + slack(grid)
    return F.when(below >= 0, F.get(grid_values, F.greatest(below, F.lit(0)))).otherwise(low), F.when(over <= grid, F.get(grid_values, F.least(over, F.lit(grid)))).otherwise(high)


def joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's state, null being a group; the one state of no groups goes to all rows."""
    if not keys:
        return rows.crossJoin(F.broadcast(state))  # one row
    same = F.lit(True)
    other = state
    for g in keys:
        other = other.withColumnRenamed(g, f"s{g}")
        same = same & F.col(g).eqNullSafe(F.col(f"s{g}"))
    return rows.join(other, same).drop(*[f"s{g}" for g in keys])


def plain_quantile(values: list[float], share: float) -> float | None:
    """The same of a list, for tests and small inputs."""
    if not values:
        return None
    v, at = sorted(values), share * (len(values) - 1)
    return v[floor(at)] + (v[ceil(at)] - v[floor(at)]) * (at - floor(at)) if abs(at) < inf else None
