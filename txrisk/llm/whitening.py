"""Whitening of embeddings: integer entries, exact sums, principal components by contour integration.

A row counts if its vector is not null and holds only finite entries. An entry c becomes
the integer floor(1024 * c) + 100000. Sums per dimension are exact; the covariance is
summed over centred vectors in tasks and added up by Spark cell by cell, so the driver
sees a table as large as the square of the dimensions and nothing that grows with rows.

Defined cases: a vector shorter than the longest one counts as ending in zeros; entries
whose integer would pass 2 ** 52 are held there; null and repeated ids are rows like any
other; other columns are ignored; components whose eigenvalue is zero to double precision
(equal vectors, fewer rows than components) are left out, as nothing can be divided by
it; no rows give no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import row_slices
from txrisk.llm.contour_eigen import largest_eigenpairs

SCALE, SHIFT, HELD = 1024, 100_000, 2.0**52
#: Rows of a vector table that a task turns into one array.
ROWS = 1024

_RESULT = [
    ("component", pa.int32()),
    ("n", pa.int64()),
    ("deviation", pa.int64()),
    ("whitened", pa.float64()),
    ("explained", pa.float64()),
]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows, sums per dimension, and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and has only finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(F.col(vector).isNotNull() & ~bad)


def integers(lists: pa.Array, width: int) -> np.ndarray:
    """The integer entries of a list column, padded with the integer of zero."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(flat * SCALE), -HELD, HELD).astype(np.int64) + SHIFT
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return x.reshape(len(lists), width)
    table = np.full((len(lists), width), SHIFT, dtype=np.int64)
    table[np.arange(width) < lengths[:, None]] = x
    return table


def _cells(table: DataFrame, summed, kind: str) -> list:
    """Sums of (cell, value) rows that tasks emit; as many rows as there are cells."""
    parts = table.mapInArrow(summed, f"cell long, value {kind}")
    return sorted(map(tuple, parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()))


def _moments(table: DataFrame, size: int, block_rows) -> np.ndarray:
    """Sum over all rows of the outer product of ``block_rows(batch)`` with itself."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in row_slices(batches, ROWS):
            rows = block_rows(batch)
            total += rows.T @ rows
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["cell", "value"])

    total = np.zeros(size * size)
    for cell, value in _cells(table, summed, "double"):
        total[cell] = value
    return total.reshape(size, size)


def fit(table: DataFrame, components: int = 8, vector: str = "embedding") -> Whitening | None:
    """Learn the whitening from all usable rows; None if there are none."""
    rows = usable(table, vector).select(vector)
    width = rows.agg(F.max(F.size(vector))).first()[0]
    if not width:
        return None

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in row_slices(batches, ROWS):
            total = [a + b for a, b in zip(total, integers(batch.column(0), width).sum(axis=0).tolist())]
            n += batch.num_rows
        if n:
            values = pa.array([str(v) for v in [*total, n]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), values], ["cell", "value"])

    parts = rows.mapInArrow(add_up, "cell long, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))
    *sums, n = (int(total) for _, total in sorted(map(tuple, parts.groupBy("cell").agg(F.sum("value")).collect())))
    mean = np.array([float(s) / n for s in sums])
    covariance = _moments(rows, width, lambda batch: integers(batch.column(0), width) - mean) / n
    trace = float(np.trace(covariance))
    values, vectors = largest_eigenpairs(covariance, components)
    real = values > width * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    fitted = Whitening(n, tuple(sums), trace, values[real], vectors[:, real])
    if not real.any():
        return fitted
    projection = fitted.projection
    whitened = _moments(rows, int(real.sum()), lambda batch: (integers(batch.column(0), width) - mean) @ projection) / n
    error = float(np.abs(whitened - np.eye(len(whitened))).max())
    return Whitening(n, fitted.sums, trace, fitted.values, fitted.vectors, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """For each row the exact sum over dimensions of (n * x - S) ** 2, null beyond 64 bits."""
    largest = max(float(np.abs(x).max(initial=0)) * n, max(map(abs, map(float, sums))))
    if 2 * largest < 2.0**62:
        y = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (y * y).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [value if value < 1 << 63 else None for value in exact]


def whiten(table: DataFrame, fitted: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row of the table and each component."""
    kind = table.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double"
    if fitted is None or not len(fitted.values):
        return table.sparkSession.createDataFrame([], f"{ddl}, identity_error double")
    n, sums, mean, projection = fitted.n, fitted.sums, fitted.mean, fitted.projection
    shares, k = fitted.values / fitted.trace, len(fitted.values)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, ROWS):
            x = integers(batch.column(1), len(sums))
            rows = batch.num_rows
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(((x - mean) @ projection).ravel()),
                pa.array(np.tile(shares, rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *(name for name, _ in _RESULT)])

    rows = usable(table, vector).select(key, vector)
    return rows.mapInArrow(project, ddl).withColumn("identity_error", F.lit(fitted.identity_error))
