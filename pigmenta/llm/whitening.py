"""Whitened principal components of vectors by a covariance in two passes.

Entries become whole numbers x = floor(1024 c) + 100000. The first pass adds them up exactly, which gives the mean. The second
centres each batch by that mean and adds up its outer products with one matrix product a batch; partial matrices are merged by
treeAggregate, so that the driver receives a few matrices, not one a task. LAPACK's symmetric solver decomposes the merged
matrix on the driver; the leading axes travel to all tasks, and the last pass projects. One more pass measures the covariance of
what comes out.

The driver and each task hold matrices of dimensions x dimensions doubles (32 KB at 64, 134 MB at 4096), nothing that grows with the rows.

Defined results
  * a vector that is null, holds a null or a non-finite entry, or one whose x is no long, is dropped; so is one whose length
    isn't the commonest length of the others (of equally common ones the longest), as there is no covariance with it;
  * ``deviation`` is exact, as decimal(38, 0); beyond 38 digits it is null;
  * an axis without variance (eigenvalue under ``LEAST`` times the largest, or all zero): ``whitened`` is null, ``explained`` its share or 0,
    and the check of the covariance leaves it out; a single vector, or none but repeated ones, has only such axes;
  * fewer dimensions than ``COMPONENTS``: as many components as dimensions; vectors of no entries give no rows;
  * ties of eigenvalues: any axes of that space, the same for all rows; an axis' largest entry (the first of equal ones) is positive;
  * repeated rows and ids: each by itself, all counted; null ids pass through; other columns, clashing names too, are ignored;
  * an empty table gives an empty result. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Share of the largest eigenvalue under which an axis has no variance.
LEAST = 1e-12
#: Entries of vectors that are worked on at once.
BLOCK = 1 << 20
_DEPTH = 2


class Whitening(NamedTuple):
    """Rows and exact sums of the fit list, eigenvalues (falling), unit axes (columns), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def _vectors(column: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the sound vectors of a batch, those of ``dims`` entries if given; one length and ``BLOCK`` entries at most at a time."""
    if not len(column):
        return
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # skips null lists
    start = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]) if dims is None else (dims,):
        rows = np.flatnonzero(lengths == size)
        for at in range(0, len(rows), max(1, BLOCK // int(size))):
            own = rows[at : at + max(1, BLOCK // int(size))]
            x = np.floor(values[start[own][:, None] + np.arange(size)] * SCALE) + SHIFT
            good = (np.abs(x) < 2.0**62).all(1)  # false for nan
            yield own[good], x[good].astype(np.int64)


def _one_column(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


def _merge(a: dict, b: dict) -> dict:
    """Sums of dictionaries of arrays (or of whole numbers in arrays)."""
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


def _tree(partial: DataFrame, read) -> dict:
    """Rows of partial results (bytes), merged in a tree."""
    return partial.rdd.treeAggregate({}, lambda a, r: _merge(a, read(r)), _merge, _DEPTH)


def _count(df: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """Exact (rows, sums by dimension) as whole numbers of Python, by length of the vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _vectors(b.column(0)):
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # neither can overflow in a block
                _merge(total, {x.shape[1]: np.array([len(x), *(int(h) * (1 << 32) + int(v) for h, v in zip(high, low, strict=True))], object)})
        if total:
            yield pa.RecordBatch.from_pydict({"dims": pa.array(list(total), pa.int32()), "sums": pa.array([[str(v) for v in s] for s in total.values()], pa.list_(pa.string()))})

    partial = _one_column(df, vector).mapInArrow(each, "dims int, sums array<string>")
    return _tree(partial, lambda r: {r["dims"]: np.array([int(v) for v in r["sums"]], object)})


def _products(df: DataFrame, vector: str, centre: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray | None:
    """Sum of outer products of the centred vectors, or of their projections ``onto`` axes (with the sum of those in a last row)."""
    dims = len(centre)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, x in _vectors(b.column(0), dims):
                y = x - centre
                y = y if onto is None else y @ onto
                own = y.T @ y if onto is None else np.vstack([y.T @ y, y.sum(0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    width = dims if onto is None else onto.shape[1]
    partial = _one_column(df, vector).mapInArrow(each, "m binary")
    return _tree(partial, lambda r: {0: np.frombuffer(r["m"], np.float64).reshape(-1, width)}).get(0)


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Mean and axes of the vectors; None if there are none."""
    counts = _count(df, vector)
    if not counts:
        return None
    dims, whole = max(counts.items(), key=lambda kv: (kv[1][0], kv[0]))
    n, sums = int(whole[0]), [int(v) for v in whole[1:]]
    v = _products(df, vector, mean_of(n, sums)) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1].copy()
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, axes, float(np.trace(v)))


def mean_of(n: int, sums: list[int]) -> np.ndarray:
    """Correctly rounded quotients."""
    return np.array([s / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over the dimensions of (n x - sum)^2, exactly; in machine numbers where they can't overflow."""
    most = max(max(int(x.max()) * n - min(sums), max(sums) - int(x.min()) * n), 1) if x.size else 1
    if most < 1 << 62 and most * most * x.shape[1] < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        exact = (off * off).sum(1).tolist()
    else:
        exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()
    return [Decimal(v) if v < 10**38 else None for v in exact]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each sound vector and component: key, component, n, deviation, whitened, explained, identity_error (see the module)."""
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    model = fit(df, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, dims = model.n, len(model.sums)
    k = min(components, dims)
    centre, values = mean_of(n, model.sums), model.values[:k]
    alive = values > LEAST * max(model.values[0], np.finfo(float).tiny)
    onto = np.where(alive, model.axes[:, :k] / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    explained = values / model.trace if model.trace > 0 else np.zeros(k)
    error = 0.0
    if alive.any():
        second = _products(df, vector, centre, onto[:, alive])
        mean = second[-1] / n
        error = float(np.abs(second[:-1] / n - np.outer(mean, mean) - np.eye(int(alive.sum()))).max())
    arrow = to_arrow_schema(schema)
    shared, sums = df.sparkSession.sparkContext.broadcast((centre, onto)), model.sums

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, axes = shared.value
        for b in batches:
            for rows, x in _vectors(b.column(1), dims):
                m = len(rows)
                y, own = (x - at) @ axes, np.repeat(rows, k)
                off = deviations(x, n, sums)
                columns = [b.column(0).take(pa.array(own)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array([d for d in off for _ in range(k)], pa.decimal128(38, 0)), pa.array(y.ravel(), from_pandas=True), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(df[key], df[vector].cast("array<double>").alias("v")).mapInArrow(each, schema)
