"""Embedding whitening by spectrum slicing.

Each entry c becomes the whole number x = floor(64 c) + 1000000; each distinct x vector counts once in the fit. Sums and
products are whole numbers throughout: vectors are centred at the rounded mean, multiplied in blocks that a double holds
exactly and added up by Spark, so that the covariance is that of the exact mean, rounded once, whatever the partitioning.

The number of eigenvalues above a shift is the number of positive pivots of an LDL' factorisation of the shifted
covariance (inertia, with pivots of one or two rows). Such counts halve an interval until it holds one eigenvalue, or
several that can't be told apart; Rayleigh quotient iteration converges inside it, and two counts just beside the value
certify its number.

Rows whose vector is null, or holds null or non-finite entries, are left out, as are vectors of another length than most
and empty ones. Repeated rows give repeated results; null vec_ids stay. Components of no variance can't be whitened: there
are as many components as have any, 16 at most; without any, or of an empty table, the result is empty. An x or a deviation
that no long holds is an error, as a wrong number would be worse. Extra columns are ignored. Only sums over dimensions reach
the driver: d sums and d x d products for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

SCALE, SHIFT = 64, 1_000_000
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the largest possible one are sought together.
CLOSE = 1e-8


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that remain."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    return rows.join(F.broadcast(common), F.size("x") == F.col("dim"), "left_semi")  # one row


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], list[int]]) -> dict[int, int]:
    """The sums over all rows of the whole numbers that `part` gives for a batch, by place; each task sends one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(batch)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], schema=pa.schema([("at", pa.int32()), ("value", kind)]))

    return {r["at"]: int(r["value"]) for r in rows.mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()}


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers, exactly, as Python integers."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest >= EXACT:
        z = z.astype(object)
        return z.T @ z
    step = max(1, EXACT // max(1, largest * largest))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for start in range(0, len(z), step):
        part = z[start : start + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and covariance of the fit's x vectors."""

    def sums(batch: pa.RecordBatch) -> list[int]:
        x = matrix(batch.column("x"), d)
        return [len(x), *np.add.reduce(x.astype(object)).tolist()] if np.abs(x).max() >= 1 << 40 else [len(x), *map(int, x.sum(0))]

    got = summed(fit, sums)
    n, total = got[0], [got[j + 1] for j in range(d)]
    centre = np.array([round_div(s, n) for s in total], np.int64)
    upper = np.triu_indices(d)
    got = summed(fit, lambda batch: exact_products(matrix(batch.column("x"), d) - centre)[upper].tolist())
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    cov = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*upper, strict=True)):
        cov[i, j] = cov[j, i] = (n * got[at] - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    return n, total, cov


def round_div(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: pivots of one or two rows, chosen by the largest entries of two columns."""
    a, n = a.copy(), len(a)
    ratio = (1 + np.sqrt(17)) / 8
    tiny = EPS * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny) * 1e-3
    k = positive = 0
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = column.max(initial=0.0)
        double = False
        if abs(a[k, k]) < ratio * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other >= ratio * most * most:
                r = k
            elif abs(a[r, r]) < ratio * other:
                double = True
        else:
            r = k
        to = k + 1 if double else k
        if r != to:
            a[[r, to], k:] = a[[to, r], k:]
            a[k:, [r, to]] = a[k:, [to, r]]
        if double:
            positive += 1  # one of either sign
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot = a[k, k] if abs(a[k, k]) > tiny else tiny
            positive += pivot > 0
            rest = a[k + 1 :, k]
            if rest.any():
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest / pivot)
            k += 1
    return int(positive)


def above(cov: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above the shift."""
    return inertia(cov - shift * np.eye(len(cov)))


def slices(cov: np.ndarray, most: int) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, first, last) that hold the leading eigenvalues number `first` to `last`, largest first.

    An interval with several is halved until they are told apart or it is as narrow as rounding allows.
    """
    span = float(np.abs(cov).sum(1).max(initial=0.0))  # no eigenvalue is larger
    least = 16 * len(cov) * EPS * span
    out, todo = [], [(least, span * (1 + 4 * EPS), above(cov, least), 0)]
    while todo:
        low, high, under, over = todo.pop()  # `under` eigenvalues above low, `over` above high
        if over >= min(most, under):
            continue
        if under - over == 1 or high - low <= CLOSE * span:
            out.append((low, high, over + 1, under))
            continue
        middle = (low + high) / 2
        count = min(max(above(cov, middle), over), under)
        todo += [(low, middle, under, count), (middle, high, count, over)]
    return out


def polished(cov: np.ndarray, low: float, high: float, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Eigenvalue and unit eigenvector in an interval by Rayleigh quotient iteration, orthogonal to the vectors found.

    An iteration that leaves the interval starts again from the half that holds the eigenvalue.
    """
    d, scale = len(cov), max(np.abs(cov).max(), np.finfo(float).tiny)
    random = np.random.default_rng(number)
    while True:
        value, x = (low + high) / 2, random.normal(size=d)
        before = np.inf
        for turn in range(12):
            for v in found:
                x = x - v * (v @ x)
            try:
                x = np.linalg.solve(cov - value * np.eye(d), x / np.linalg.norm(x))
            except np.linalg.LinAlgError:
                x = np.linalg.solve(cov - (value + 4 * EPS * scale) * np.eye(d), x)
            for v in found:
                x = x - v * (v @ x)
            x /= np.linalg.norm(x)
            if turn:  # the first turns stay at the middle, which fixes the eigenvalue that is meant
                value = float(x @ cov @ x)
            away = float(np.linalg.norm(cov @ x - (x @ cov @ x) * x))
            if turn > 1 and away >= before / 4 and away <= 64 * d * EPS * scale:
                break
            before = away
        slack = 4 * d * EPS * scale
        if low - slack <= value <= high + slack and away <= 64 * d * EPS * scale:
            return value, x
        if high - low <= slack:
            raise ArithmeticError(f"no eigenvector found for component {number}")
        middle = (low + high) / 2
        low, high = (middle, high) if above(cov, middle) >= number else (low, middle)


def leading(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading positive eigenvalues, falling, and their vectors as columns; counts certify each number."""
    d, values, vectors = len(cov), [], []
    beside = 128 * d * EPS * float(np.abs(cov).max(initial=0.0))
    for low, high, first, last in slices(cov, most):
        group = []
        for number in range(first, last + 1):
            value, x = polished(cov, low, high, number, vectors)
            vectors.append(x * np.sign(x[int(np.abs(x).argmax())]))
            group.append(value)
        for number, value in enumerate(sorted(group, reverse=True), first):
            alone = last == first
            if above(cov, value - beside) < number or (alone and above(cov, value + beside) >= number):
                raise ArithmeticError(f"eigenvalue {value} isn't number {number}")
        values += group
    order = np.argsort(-np.array(values), kind="stable")[:most]
    return np.array(values)[order], np.array(vectors).reshape(-1, d)[order].T


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row that remains."""
    spark = vectors.sparkSession
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = staged(whole_vectors(vectors))
    fit = staged(rows.groupBy("x").agg(F.count(F.lit(1)).alias("times")).select("x"))
    one = fit.select(F.size("x").alias("d")).first()
    values = np.empty(0)
    if one is not None:
        d = one["d"]
        n, total, cov = moments(fit, d)
        values, basis = leading(cov, components)
    if not len(values):
        dropped(rows, fit)
        return spark.createDataFrame([], ddl)
    sums, trace, k = np.array(total, np.int64), float(np.trace(cov)), len(values)
    scaled = basis / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((n * x - sums) / n) @ scaled

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whitened fit's sums and products of one task."""
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projected(matrix(batch.column("x"), d))
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    got = {r["at"]: r["value"] for r in fit.mapInArrow(grams, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    gram = np.array([got[j] for j in range((k + 1) * k)]).reshape(k + 1, k) / n
    error = float(np.abs(gram[:k] - np.outer(gram[k], gram[k]) - np.eye(k)).max())
    dropped(fit)
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                batch = whole.slice(start, 5000)
                x = matrix(batch.column("x"), d)
                if float(n) * float(np.abs(x).max(initial=0)) >= 2.0**62:
                    raise OverflowError("n * x doesn't fit a long")
                away = n * x - sums
                if (away.astype(float) ** 2).sum(1).max(initial=0) >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a deviation doesn't fit a long")
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat((away * away).sum(1), k)), pa.array(projected(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    schema=schema,
                )

    return rows.mapInArrow(run, ddl)
