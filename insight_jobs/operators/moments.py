"""Pairwise moments of many numeric columns in one scan.

A task multiplies its rows' values and null masks block by block (Arrow batches), shifted by values of its own so that
little cancels, and sends a row for each column: counts, sums, squares and products with every later column over the rows that
have both. Spark deals these rows by column; a stream of them is added up, moved to one shift, and gives the correlations.
The scan is one whatever the number of columns, and what a task holds is bounded by their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import value

PARTS = ("n", "sx", "sy", "xx", "yy", "xy")
#: A variance under this share of its mean square about the shift may be rounding alone.
CANCELLED = 1e-12


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """at (a column's place), shift, and n, sx, sy, xx, yy, xy: of it (x) with every later column (y), one row a task."""
    c = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            there = np.column_stack([np.asarray(x.is_valid()) for x in batch.columns]).astype(float)
            x = np.column_stack([x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in batch.columns])
            if shift is None:
                shift = np.array([v[m > 0].mean() if (m > 0).any() else 0.0 for v, m in zip(x.T, there.T, strict=True)])
                first = np.array([v[m > 0][0] if (m > 0).any() else 0.0 for v, m in zip(x.T, there.T, strict=True)])
                same = np.array([bool((v[m > 0] == f).all()) for v, m, f in zip(x.T, there.T, first, strict=True)])
                shift = np.where(same | ~np.isfinite(shift), first, shift)
                shift[~np.isfinite(shift)] = 0.0
                sums = np.zeros((4, c, c))
            x = np.where(there > 0, x - shift, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        if sums is not None:
            n, s, q, p = sums
            rows = [[n[i, i + 1 :], s[i, i + 1 :], s[i + 1 :, i], q[i, i + 1 :], q[i + 1 :, i], p[i, i + 1 :]] for i in range(c - 1)]
            fields = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.float64())) for k in range(len(PARTS))]
            yield pa.RecordBatch.from_arrays([pa.array(range(c - 1), pa.int32()), pa.array([shift.tolist()] * (c - 1), pa.list_(pa.float64())), *fields], names=["at", "shift", *PARTS])

    chosen = df.select(*[value(x).alias(f"c{k}") for k, x in enumerate(columns)])
    return chosen.mapInArrow(run, f"at int, shift array<double>, {', '.join(f'{p} array<double>' for p in PARTS)}")


def moved(row: dict[str, np.ndarray], by_x: float, by_y: np.ndarray) -> dict[str, np.ndarray]:
    """Moments about another shift, which lies `by` lower."""
    n, sx, sy = row["n"], row["sx"], row["sy"]
    return {"n": n, "sx": sx + by_x * n, "sy": sy + by_y * n, "xx": row["xx"] + 2 * by_x * sx + by_x**2 * n, "yy": row["yy"] + 2 * by_y * sy + by_y**2 * n, "xy": row["xy"] + by_x * sy + by_y * sx + by_x * by_y * n}


def correlations(moments: DataFrame) -> DataFrame:
    """at, other, r, sure: Pearson's r of each pair of places, null where either is constant; not `sure` where too much cancelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shift, total = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                parts = {p: np.array(row[p]) for p in PARTS}
                mine = np.array(row["shift"])
                if row["at"] != now:
                    if now is not None:
                        yield finished(now, total)
                    now, shift, total = row["at"], mine, parts
                    continue
                by = mine - shift
                parts = moved(parts, by[now], by[now + 1 :])
                total = {p: total[p] + parts[p] for p in PARTS}
        if now is not None:
            yield finished(now, total)

    return moments.repartition("at").sortWithinPartitions("at").mapInArrow(run, "at int, other int, r double, sure boolean")


def finished(at: int, m: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = np.maximum(m["n"], 1)
    with np.errstate(all="ignore"):
        vx, vy = m["xx"] / n - (m["sx"] / n) ** 2, m["yy"] / n - (m["sy"] / n) ** 2
        cov = m["xy"] / n - m["sx"] / n * m["sy"] / n
        r = cov / np.sqrt(vx) / np.sqrt(vy)
        exact = (m["xx"] == 0) | (m["yy"] == 0) | (m["n"] == 0)  # a constant at the shift itself
        sure = exact | ((vx > CANCELLED * m["xx"] / n) & (vy > CANCELLED * m["yy"] / n) & np.isfinite(r))
    none = exact | ~np.isfinite(r)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), at, np.int32)), pa.array(np.arange(at + 1, at + 1 + len(n), dtype=np.int32)), pa.array(np.where(none, 0.0, np.clip(r, -1, 1)), mask=none), pa.array(sure)], names=["at", "other", "r", "sure"])


def rounded(r: Column, digits: int = 3) -> Column:
    """r to some digits; a negative one that rounds to zero keeps its sign, as in SQL."""
    short = F.round(r, digits)
    return F.when((r < 0) & (short == 0), F.lit(-0.0)).otherwise(short)


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """at, other, r, sure of all pairs of the columns' places."""
    return correlations(pair_moments(df, columns)).select("at", "other", rounded(F.col("r")).alias("r"), "sure")
