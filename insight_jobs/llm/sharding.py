"""Balanced label propagation: documents with links move towards the shards of their neighbours, under quotas.

Links join equal texts (each text's copies are a group). The unit that moves is a cell: the copies of one text that a
hash of doc_id put into one of `salts` parts, so that a text with any share of all rows is still many units. Every
cell starts in the shard of its part. In each turn a cell asks to move to the shard that holds most of its group:
in even turns among the shards that have room, in odd turns among all that the group doesn't fill already. Arrivals are
netted with departures, so that full shards swap; of each pair of shards as many requests are accepted as the quotas
allow, largest groups first, cut off at the cell. It goes on until no turn of either kind moves anything: each move
brings a group closer together, so it ends. Then documents without links fill each shard up to its quota exactly.

Law `rows`: shard counts are at most one apart. Null and empty texts have no link and 0 bytes of text. Rows with equal
doc_id are placed one by one, repeated rows too. Very long texts count by their bytes. `cut_edges` says how many
links a result cuts. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, staged

BUCKETS = 1024
#: Turns without a move after which it ends: two of each kind, with other ties.
IDLE = 4


def _by_shard(values: list[int]) -> Column:
    """The value of the row's shard."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("shard"))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        out[r["shard"]] = r["n"]
    return out


def _allowed(asked: np.ndarray, loads: list[int], quotas: list[int]) -> np.ndarray:
    """How many of the rows asked for (from, to) may move at once, so that nobody gains beyond the quota.

    All are accepted first; then arrivals of the fullest shard are refused, from the emptiest shards first, until none is
    too full that has arrivals. The matrix is of shards x shards, whatever the input.
    """
    moved = asked.copy()
    while True:
        over = np.array(loads) + moved.sum(0) - moved.sum(1) - np.array(quotas)
        full = np.where(moved.sum(0) > 0, over, 0)
        t = int(full.argmax())
        if full[t] <= 0:
            return moved
        left = int(full[t])
        for s in np.argsort(over, kind="stable"):
            cut = min(left, int(moved[s, t]))
            moved[s, t] -= cut
            left -= cut


def _first(asking: DataFrame, allowed: np.ndarray) -> DataFrame:
    """The cells of `asking` that fit into what each pair of shards may move, in the order of size class and bucket.

    Running sums of bounded counts (size classes x BUCKETS a pair) give each bucket its place; only the cells of the
    one bucket that a limit cuts through are ranked together. A group has at most one cell for each salt.
    """
    pair = ["shard", "target"]
    limits = asking.sparkSession.createDataFrame([(int(s), int(t), int(allowed[s, t])) for s, t in np.argwhere(allowed)], "shard int, target int, allowed long")
    before = Window.partitionBy(*pair).orderBy(F.desc("size_class"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = asking.groupBy(*pair, "size_class", "bucket").agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    places = sums.join(F.broadcast(limits), pair).where("before < allowed")  # at most shards x shards rows
    placed = asking.join(places, [*pair, "size_class", "bucket"])
    inside = Window.partitionBy(*pair).orderBy(F.xxhash64("grp"), "grp", "salt").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.where("before + rows <= allowed")
    cut = placed.where("before + rows > allowed").withColumn("upto", F.col("before") + F.sum("n").over(inside)).where("upto <= allowed")
    return whole.select("grp", "salt", "target").union(cut.select("grp", "salt", "target"))


def propagate(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """cells (grp, salt, n, shard) with shards after the last turn that moved any."""
    shards = len(quotas)
    turn = idle = 0
    while idle < IDLE:
        loads = _loads(cells, shards)
        open_only = turn % 2 == 0
        room = [q - load for q, load in zip(quotas, loads, strict=True)]
        # A group has a cell for each salt at most, so that windows over groups are of bounded size; one exchange serves both.
        group = Window.partitionBy("grp")
        held = cells.withColumn("held", F.sum("n").over(Window.partitionBy("grp", "shard"))).withColumn("total", F.sum("n").over(group))
        target = _by_shard(room) > 0 if open_only else F.col("held") < _by_shard(quotas)
        ranked = held.withColumn("rank", F.struct(F.col("held"), F.xxhash64("grp", "shard", F.lit(turn)).alias("tie"), F.col("shard")))
        best = ranked.withColumn("best", F.max(F.when(target, F.col("rank"))).over(group))
        asking = staged(
            best.where("best > rank")
            .select("grp", "salt", "n", "shard", F.col("best.shard").alias("target"), F.floor(F.log2(F.col("total") + 1)).cast("int").alias("size_class"))
            .withColumn("bucket", F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(BUCKETS)).cast("int"))
        )
        asked = np.zeros((shards, shards), np.int64)
        for r in asking.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
            asked[r["shard"], r["target"]] = r["n"]
        if not open_only and not asked.any():
            break
        allowed = _allowed(asked, loads, quotas)
        moved = 0
        if allowed.any():
            moves = staged(_first(asking, allowed))
            moved = moves.count()
        if moved:
            cells = staged(cells.join(moves, ["grp", "salt"], "left").select("grp", "salt", "n", F.coalesce("target", "shard").alias("shard")))
        idle = 0 if moved else idle + 1
        turn += 1
    return cells


def cut_edges(placed: DataFrame) -> DataFrame:
    """links, cut: pairs of rows with equal texts, and those of them in different shards, of a result of balanced_shards."""
    pairs = lambda n: n * (n - 1) / 2
    here = placed.where("text_key IS NOT NULL").groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = here.groupBy("text_key").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("whole"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(total("links").alias("links"), total(F.col("links") - F.col("whole")).alias("cut"))


def balanced_shards(docs: DataFrame, shards: int = 24, salts: int = 240) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), text_key (null for empty texts).

    Rows are told apart by `row`, which their place in the table gives once, so that repeated rows are spread, too.
    """
    text = F.col("text").cast("string")
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    base = staged(docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.length(text) > 0, F.md5(text)).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    ))
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.pmod("row", F.lit(salts))), F.lit(salts)).cast("int"))
    rows = base.count()
    quotas = [rows // shards + (k < rows % shards) for k in range(shards)]
    parts = staged(base.where("grp IS NOT NULL").groupBy("grp", "salt").agg(F.count(F.lit(1)).alias("n")))
    several = parts.groupBy("grp").agg(F.sum("n").alias("total")).where("total > 1").select("grp")
    cells = staged(parts.join(several, "grp").withColumn("shard", F.pmod(F.col("salt"), F.lit(shards))))
    cells = propagate(cells, quotas)
    placed = staged(base.join(cells.select("grp", "salt", "shard"), ["grp", "salt"], "left").select("doc_id", "size", "text_crc32", "grp", "row", "shard"))
    linked = numbered(placed.where("shard IS NOT NULL"), ["shard"], ["doc_id", "grp", "row"], "place")
    fitting = F.col("place") < _by_shard(quotas)
    kept = staged(linked.withColumn("shard", F.when(fitting, F.col("shard"))).drop("place"))
    taken = [0] * shards
    for r in kept.where("shard IS NOT NULL").groupBy("shard").count().collect():
        taken[r["shard"]] = r["count"]
    ends, end = [], 0
    for q, t in zip(quotas, taken, strict=True):
        end += q - t
        ends.append(end)
    loose = numbered(placed.where("shard IS NULL").union(kept.where("shard IS NULL")), [], ["doc_id", "text_crc32", "row"], "place")
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place")))
    full = staged(kept.where("shard IS NOT NULL").union(loose.withColumn("shard", shard).drop("place")))
    slots = numbered(full, ["shard"], ["doc_id", "text_crc32", "row"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("text_key"))
