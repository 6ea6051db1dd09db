"""Whitening of vectors by a covariance from exact variances (polarisation).

Entries c become whole numbers x = floor(1024 c) + 100000. The count and the
sums S of every dimension are aggregated first; then, with y = x - floor(S / n),
the exact sums of y_i^2 for every dimension and of (y_i + y_j)^2 for every pair
of dimensions. What the whole-numbered centre leaves over is known exactly, so
the variances of dimensions and of sums of two are exact fractions, and
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2 loses nothing to cancellation.
The matrix, rounded once to doubles, goes to ``eigh``.

Tasks return sums of one row per pair of dimensions; the driver gets as many
numbers as the matrix has, whatever the number of vectors.

Defined results: vectors that are null, hold null or non-finite entries, or an
entry beyond 2^40 in size (where x is no longer exact) are left out, as are
vectors of another length than the most frequent one (of equally frequent ones
the longest). Repeated rows count each; null identifiers stay null; of equal
eigenvalues the vectors are those ``eigh`` gives; the largest entry of a
component is positive. Along a component without variance ``whitened`` is null,
and it does not count for ``identity_error``, which is 0 where none counts;
``explained`` is null where there is no variance at all. ``deviation`` beyond a
long is null. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
ROWS = 2048  # vectors in one block of sums
EXACT = 1 << 62  # below it sums are made in longs, from it on in unbounded integers
SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def usable(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows and their entries as a matrix. Without a width
    rows of any length count, and the matrix is empty."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(value) <= LARGEST)  # not a number fails too
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.asarray(vectors.is_valid()) & (sizes > 0) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
    if width is None:
        return np.flatnonzero(good), np.zeros((0, 0))
    good &= sizes == width
    return np.flatnonzero(good), value[np.repeat(good, sizes)].reshape(-1, width)


def whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vector.alias("vector"))


def totals(rows: DataFrame, sums, width: int | None) -> dict[int, int]:
    """Exact totals over all rows of what ``sums`` gives for a block's matrix,
    one per key; as many as ``sums`` has keys come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            good, matrix = usable(b.column(0), width)
            for at in range(0, len(good), ROWS):
                block = matrix[at : at + ROWS] if width is not None else b.column(0).take(pa.array(good[at : at + ROWS]))
                for k, v in sums(block):
                    total[k] = total.get(k, 0) + int(v)
        keys = sorted(total)
        amounts = [str(total[k]) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(amounts, pa.string())], names=["key", "amount"])

    got = rows.select("vector").mapInArrow(run, "key bigint, amount string")
    got = got.groupBy("key").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    return {r.key: int(r.amount) for r in got.collect()}


def width_of(rows: DataFrame) -> int | None:
    """The most frequent length; one number per length comes to the driver."""

    def sizes(block: pa.Array) -> Iterator[tuple[int, int]]:
        lengths, number = np.unique(block.value_lengths().to_numpy(), return_counts=True)
        yield from zip(lengths.tolist(), number.tolist())

    found = totals(rows, sizes, None)
    return max(found, key=lambda w: (found[w], w)) if found else None


def pair_sums(y: np.ndarray) -> np.ndarray:
    """Sums of (y_i + y_j)^2 in the order of ``np.triu_indices``; y_i^2 at i = j."""
    d = y.shape[1]
    if len(y) and (2 * int(np.abs(y).max())) ** 2 * len(y) >= EXACT:
        y = y.astype(object)
    out = []
    for i in range(d):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        out.append((both * both).sum(axis=0))
    return np.concatenate(out)


@dataclass
class Fit:
    """Count, exact sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  # falling
    axes: np.ndarray  # a column per component

    @property
    def positive(self) -> np.ndarray:
        """Components with a variance above rounding."""
        return self.values > self.values.max(initial=0) * len(self.values) * np.finfo(float).eps


def fit(rows: DataFrame) -> Fit | None:
    """``rows(vec_id, vector)``; three passes: length, sums, squares of sums."""
    d = width_of(rows)
    if d is None:
        return None

    def linear(block: np.ndarray) -> Iterator[tuple[int, int]]:
        x = whole(block)
        yield d, len(x)
        yield from enumerate(x.sum(axis=0) if np.abs(x).max() < EXACT // ROWS else x.astype(object).sum(axis=0))

    first = totals(rows, linear, d)
    n, sums = first[d], [first[i] for i in range(d)]
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]

    squares = totals(rows, lambda block: enumerate(pair_sums(whole(block) - centre)), d)
    variance = {}
    for k, (i, j) in enumerate(zip(*map(np.ndarray.tolist, np.triu_indices(d)))):
        r = rest[i] if i == j else rest[i] + rest[j]
        variance[i, j] = Fraction(squares[k], n) - Fraction(r * r, n * n)
    covariance = np.empty((d, d))
    for (i, j), v in variance.items():
        covariance[i, j] = covariance[j, i] = float(v if i == j else (v - variance[i, i] - variance[j, j]) / 2)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return Fit(n, sums, covariance, values, axes)


def project(model: Fit, entries: np.ndarray, components: int) -> tuple[np.ndarray, list[int]]:
    """Whitened coordinates of raw entries, and the exact sum of (n x - S)^2 of each row."""
    x, n = whole(entries), model.n
    centre = np.array([s // n for s in model.sums], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(model.sums, centre)], object)
    y = x - centre
    far = n * (int(np.abs(y).max(initial=0)) + 1)
    if far * far * len(centre) < EXACT:
        away = n * y - rest.astype(np.int64)
        deviation = (away * away).sum(axis=1).tolist()
    else:
        exact = n * y.astype(object) - rest
        deviation = (exact * exact).sum(axis=1).tolist()
    offset = (rest / n).astype(float) if len(rest) else np.zeros(0)
    value = (y - offset) @ model.axes[:, :components]
    return value / np.sqrt(np.where(model.positive, model.values, 1))[:components], deviation


def identity_error(rows: DataFrame, model: Fit, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on the rows."""
    d, live = len(model.sums), np.flatnonzero(model.positive[:components])
    k = len(live)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k)
        for b in batches:
            good, matrix = usable(b.column(0), d)
            w = project(model, matrix, components)[0][:, live]
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["key", "amount"])

    got = rows.select("vector").mapInArrow(run, "key bigint, amount double").groupBy("key").agg(F.sum("amount").alias("amount"))
    amount = np.array([r.amount for r in got.orderBy("key").collect()]) / model.n
    mean, square = amount[:k], amount[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """A row per usable vector and component."""
    rows = rows_of(df, id_col, vector_col)
    model = fit(rows)
    if model is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    d = len(model.sums)
    k = min(components, d)
    error = identity_error(rows, model, k)
    trace = float(np.trace(model.covariance))
    explained = model.values[:k] / trace if trace > 0 else None
    live = model.positive[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, matrix = usable(b.column(1), d)
            value, deviation = project(model, matrix, k)
            m = len(good)
            columns = [
                b.column(0).take(pa.array(np.repeat(good, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array([v if v < 1 << 63 else None for v in deviation for _ in range(k)], pa.int64()),
                pa.array(value.ravel(), mask=np.tile(~live, m)),
                pa.array(np.tile(explained, m)) if explained is not None else pa.nulls(m * k, pa.float64()),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
