"""Embedding whitening: Welford updates in partition iterators, merged by the parallel formula, then a symmetric QR eigen-solve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, prepare, schema

#: Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT, and so many components are returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries as large as this count as not finite: their steps would not be whole numbers in a double.
LARGEST = float(1 << 46)
#: Tasks that merge states before the last one does.
FAN = 64
#: Rows of a batch that is multiplied at once.
ROWS = 512

STATE = "n bigint, mean array<double>, m2 array<double>, sums array<decimal(38,0)>"


class Moments:
    """Count, mean, sums of products of deviations and exact sums of the vectors seen."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.m2, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d
        self._outer = np.empty((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates by the rows of a float64 matrix, one vector at a time."""
        mean, m2, n, outer = self.mean, self.m2, self.n, self._outer
        for x in rows:
            n += 1
            before = x - mean
            mean += before / n
            np.multiply(before[:, None], x - mean, out=outer)
            m2 += outer
        self.n = n

    def count(self, rows: np.ndarray) -> None:
        """Exact sums of an int64 matrix whose entries are below 2**53."""
        for k in range(0, len(rows), ROWS):
            self.sums = [a + int(b) for a, b in zip(self.sums, rows[k : k + ROWS].sum(axis=0), strict=True)]

    def merge(self, n: int, mean: np.ndarray, m2: np.ndarray, sums: list[int]) -> None:
        if not n:
            return
        total = self.n + n
        apart = mean - self.mean
        self.mean = self.mean + apart * (n / total)
        self.m2 = self.m2 + m2 + np.outer(apart, apart) * (self.n / total * n)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def batch(self) -> pa.RecordBatch:
        sums = pa.array([[Decimal(x) for x in self.sums]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([self.mean.tolist()]), pa.array([self.m2.ravel().tolist()]), sums], names=["n", "mean", "m2", "sums"])

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], d: int) -> Moments:
        """All states of an iterator, merged one by one."""
        out = cls(d)
        for batch in batches:
            for n, mean, m2, sums in zip(*(batch.column(k) for k in range(4)), strict=True):
                out.merge(n.as_py(), mean.values.to_numpy(), m2.values.to_numpy().reshape(d, d), [int(x) for x in sums.as_py()])
        return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): a = q T q' by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        top = np.abs(x).max()
        if top == 0:
            continue
        x /= top  # so that squares don't underflow
        size = np.linalg.norm(x)
        x[0] += np.copysign(size, x[0])
        size *= top
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - x * (x @ p)
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, by implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    main, off, q = tridiagonal(np.asarray(a, dtype=np.float64))
    rows, end, eps = np.ascontiguousarray(q.T), len(main) - 1, np.finfo(float).eps
    while end > 0:
        small = np.abs(off[:end]) <= eps * (np.abs(main[:end]) + np.abs(main[1 : end + 1]))
        off[:end][small] = 0
        if off[end - 1] == 0:
            end -= 1
            continue
        start = end - 1
        while start > 0 and off[start - 1] != 0:
            start -= 1
        half = (main[end - 1] - main[end]) / 2
        shift = main[end] - off[end - 1] ** 2 / (half + np.copysign(np.hypot(half, off[end - 1]), half or 1.0))
        x, z = main[start] - shift, off[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                off[k - 1] = r
            a0, a1, b = main[k], main[k + 1], off[k]
            main[k] = c * c * a0 + 2 * c * s * b + s * s * a1
            main[k + 1] = s * s * a0 - 2 * c * s * b + c * c * a1
            off[k] = c * s * (a1 - a0) + (c * c - s * s) * b
            x = off[k]
            if k < end - 1:
                z = s * off[k + 1]
                off[k + 1] *= c
            rows[[k, k + 1]] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-main, kind="stable")
    return main[order], rows[order]


@dataclass
class Whitener:
    """What a fit list gives: its count, exact sums, largest eigenvalues, components (rows) and the trace of its covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def floor(self) -> float:
        """Eigenvalues at or below this are rounding: no direction of the data has them."""
        return len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The rows of an int64 matrix on each component, over the root of its eigenvalue; nan where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > self.floor(), self.centred(x) @ self.components.T / np.sqrt(self.values), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, in double: the whole part of the mean is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        part = np.array([float(Fraction(s - w * self.n, self.n)) for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - part

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n*x - S)**2, exactly."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if far < 1 << 62 else object
        apart = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        most = int(np.abs(apart).max(initial=0))
        if kind is np.int64 and most * most * len(self.sums) >> 63:
            return [sum(y * y for y in row) for row in apart.tolist()]
        return [int(y) for y in (apart * apart).sum(axis=1)]


def whole(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of every entry, as bigint."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint"))


def valid(vector: Column) -> Column:
    """Neither null nor with entries that are null, not finite or beyond LARGEST."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An int64 matrix of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(fit: DataFrame, column: str, d: int, whitener: Whitener | None = None) -> DataFrame:
    """One row of STATE over all vectors of fit, or over what whitener makes of them.

    Each partition is one iterator with one state of d*d numbers; FAN tasks merge those of many, one merges theirs.
    """
    out = d if whitener is None else len(whitener.values)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(out)
        for batch in batches:
            x = matrix(batch.column(0), d)
            if whitener is None:
                state.count(x)
                state.add((x - SHIFT).astype(np.float64))
            else:
                state.add(whitener.whiten(x))
        if state.n:
            yield state.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.of(batches, out)
        if state.n:
            yield state.batch()

    states = fit.select(column).mapInArrow(partition, STATE).withColumn("_to", F.spark_partition_id())
    merged = states.repartition(FAN, "_to").drop("_to").mapInArrow(merge, STATE)
    return merged.repartition(1).mapInArrow(merge, STATE)


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> tuple[Whitener | None, float | None]:
    """The whitener of the distinct vectors of a column array<bigint>, all of one length, and its identity error; None without vectors.

    The eigen-solve runs in a task. The driver gets the sums, the eigenvalues and the components: numbers that
    depend on the vectors' length alone. The identity error is measured on the whitened vectors themselves.
    """
    spark = vectors.sparkSession
    prepare(spark)
    once = materialize(vectors.select(F.col(column).alias("x")).distinct(), "fit")
    d = once.select(F.size("x").alias("d")).limit(1).collect()
    if not d or not d[0][0]:
        return None, None
    d = d[0][0]
    k = min(components, d)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.of(batches, d)
        if state.n:
            values, rows = symmetric_qr(state.m2 / state.n)
            sums = pa.array([[Decimal(x) for x in state.sums]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([state.n], pa.int64()), sums, pa.array([values[:k].tolist()]), pa.array([rows[:k].ravel().tolist()]), pa.array([float(np.trace(state.m2)) / state.n])], names=["n", "sums", "e", "q", "trace"])

    row = moments(once, "x", d).mapInArrow(solve, "n bigint, sums array<decimal(38,0)>, e array<double>, q array<double>, trace double").first()
    found = Whitener(row.n, [int(x) for x in row.sums], np.array(row.e), np.array(row.q).reshape(k, d), row.trace)
    again = moments(once, "x", d, found).select("n", "m2").first()
    error = np.abs(np.array(again.m2).reshape(k, k) / again.n - np.eye(k))
    real = found.values > found.floor()
    return found, float(error[real][:, real].max()) if real.any() else None


def apply(rows: DataFrame, whitener: Whitener, error: float | None, carry: list[str], column: str = "x") -> DataFrame:
    """A row for each row and component, with the carried columns."""
    carried = [f for f in rows.schema if f.name in carry]
    kept, k = [f.name for f in carried], len(whitener.values)
    share = whitener.values / whitener.trace if whitener.trace > 0 else np.full(k, np.nan)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(start, ROWS)
                x = matrix(batch.column(batch.schema.get_field_index("x")), len(whitener.sums))
                n = len(x)
                each = pa.array(np.repeat(np.arange(n), k))
                far = pa.array([Decimal(y) for y in whitener.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).take(each) for c in kept), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, whitener.n)), far.take(each)]
                    + [pa.array(y, from_pandas=True) for y in (whitener.whiten(x).ravel(), np.tile(share, n))] + [pa.array([error] * (n * k), pa.float64())],
                    names=[*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(*kept, F.col(column).alias("x")).mapInArrow(fn, schema(carried, "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, carry: list[str] | None = None) -> DataFrame:
    """For each row of df with a usable vector, and each of the first components: the carried columns (all but the vector, if
    none are named), component (from 1), n, deviation (decimal, exact), whitened, explained and identity_error.

    Entries are first made whole numbers (see whole). Rows are dropped whose vector is null, is empty, holds null, non-finite
    or too large entries, or isn't of the most common length (of equally common ones the longest). All distinct vectors
    are fitted, each once, however often it occurs. Where an eigenvalue is 0 (fewer distinct vectors than
    components, a constant dimension) whitened is null and the identity error leaves the component out; with a single vector
    explained is null too. Null and repeated ids stay. Columns with the names of results are replaced. No usable rows give no rows.
    """
    prepare(df.sparkSession)
    results = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in df.columns if (c != vector if carry is None else c in carry) and c not in results]
    rows = df.where(valid(F.col(vector)) & (F.size(vector) > 0)).select(*kept, whole(F.col(vector)).alias("_x"))
    sizes = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    rows = rows.where(F.size("_x") == d)
    found, error = fit(rows, "_x", components)
    if found is None:
        found, error = Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), None
        rows = rows.limit(0)
    return apply(rows, found, error, kept, "_x")
