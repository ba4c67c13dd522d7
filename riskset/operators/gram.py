"""Correlations and moments of many columns from one scan each.

A task sums masked Gram matrices over its Arrow batches: with X the cells
(missing ones as 0) and M the mask of present cells, X'X, X'M, (X*X)'M and M'M
hold for every pair of columns all that its Pearson correlation over pairwise
complete rows needs. Matrices leave a task as tiles of ``TILE`` x ``TILE``
columns, are summed tile by tile, and each tile's correlations are rows of the
result. Columns are shifted by the means of the first rows, which correlations
do not feel, so that sums do not cancel. Plans are the same for 10 columns and
for 700.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128                  # columns a side of a tile
FIRST_ROWS = 1000           # whose means shift the columns
CONSTANT = 1e-12            # of the squares: what rounding leaves of a constant column's variance
ROWS = 4096                 # rows summed at once


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[_c(c).cast("double") for c in cols]).alias("x"))


def matrices(batch: pa.RecordBatch, p: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and their mask, ``rows`` rows at a time; null and NaN cells are missing."""
    column = batch.column("x")
    for a in range(0, len(column), rows):
        x = column.slice(a, rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
        mask = ~np.isnan(x)
        yield np.where(mask, x, 0.0), mask.astype(np.float64)


def _shift(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    first = _cells(df, cols).limit(FIRST_ROWS).toArrow().combine_chunks().to_batches()
    total, n = np.zeros(len(cols)), np.zeros(len(cols))
    for batch in first:
        for x, mask in matrices(batch, len(cols)):
            x = np.where(np.isfinite(x), x, 0.0)
            total, n = total + x.sum(axis=0), n + mask.sum(axis=0)
    return total / np.maximum(n, 1)


def correlations(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, syy: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Pearson's r from sums over the same rows; NaN for fewer than two rows or a constant column."""
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        r = (n * sxy - sx * sy) / np.sqrt(vx * vy)
        flat = (n < 2) | (vx <= CONSTANT * n * sxx) | (vy <= CONSTANT * n * syy)
    return np.where(flat, np.nan, np.clip(r, -1.0, 1.0))


def correlation_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) for every pair of columns, in the order of ``cols``; null where it is undefined."""
    cols = list(cols)
    p, tiles = len(cols), -(-len(cols) // TILE)
    if p < 2:
        return df.limit(0).select(F.lit("").alias("col_a"), F.lit("").alias("col_b"), F.lit(0.0).alias("corr"))
    shift = _shift(df, cols)
    names = pa.array(cols, pa.string())
    sums = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("sums", pa.list_(pa.float64()))])
    out = pa.schema([("col_a", pa.string()), ("col_b", pa.string()), ("corr", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, xy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            for x, mask in matrices(batch, p):
                x = (x - shift) * mask
                n += mask.T @ mask
                s += x.T @ mask
                ss += (x * x).T @ mask
                xy += x.T @ x
        for a in range(tiles):
            for b in range(a, tiles):
                i, j = slice(a * TILE, (a + 1) * TILE), slice(b * TILE, (b + 1) * TILE)
                if n[i, j].any():
                    # For a tile of pairs (x, y): n, sum x, sum y, sum xx, sum yy, sum xy.
                    own = np.stack([n[i, j], s[i, j], s[j, i].T, ss[i, j], ss[j, i].T, xy[i, j]])
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()),
                                                      pa.array([own.ravel()], pa.list_(pa.float64()))], schema=sums)

    def finish(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        high, wide = (min(TILE, p - t * TILE) for t in (a, b))
        total = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        r = correlations(*total.reshape(6, high, wide))
        i, j = np.nonzero(np.arange(high)[:, None] + a * TILE < np.arange(wide)[None, :] + b * TILE)
        own = r[i, j]
        return pa.table([names.take(pa.array(i + a * TILE)), names.take(pa.array(j + b * TILE)),
                         pa.array(own, mask=np.isnan(own))], schema=out)

    tiled = _cells(df, cols).mapInArrow(run, "a int, b int, sums array<double>")
    return tiled.groupBy("a", "b").applyInArrow(finish, "col_a string, col_b string, corr double")


def _per_column(cells: DataFrame, p: int, width: int, add, join) -> np.ndarray | None:
    """A (p, width) matrix of all rows: ``add(batch, so far)`` in tasks, ``join(matrices)`` across; None without rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((p, width)), False
        for batch in batches:
            if batch.num_rows:
                total, some = add(batch, total), True
        if some:
            for a in range(0, p, TILE):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([total[a:a + TILE].ravel()])],
                                                 names=["a", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        parts = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1, width)
        return pa.table([table["a"][:1], pa.array([join(parts).ravel()], pa.list_(pa.float64()))], names=["a", "sums"])

    rows = cells.mapInArrow(run, "a int, sums array<double>").groupBy("a").applyInArrow(merge, "a int, sums array<double>").collect()
    if not rows:
        return None
    return np.concatenate([np.array(r["sums"]).reshape(-1, width) for r in sorted(rows, key=lambda r: r["a"])])


def null_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, list[int]]:
    """Rows, and null cells of each column; a row's cells travel as one bit each."""
    cols = list(cols)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> np.ndarray:
        flags = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cols) + 1)
        return total + flags.sum(axis=0)[:, None]

    cells = df.select(F.array(F.lit(True), *[_c(c).isNull() for c in cols]).alias("x"))
    total = _per_column(cells, len(cols) + 1, 1, add, lambda parts: parts.sum(axis=0))
    counts = [0] * (len(cols) + 1) if total is None else [int(x) for x in total[:, 0]]
    return counts[0], counts[1:]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, mean, squared deviations) of two parts as one."""
    n = a[:, 0] + b[:, 0]
    share, delta = b[:, 0] / np.maximum(n, 1), b[:, 1] - a[:, 1]
    return np.column_stack([n, a[:, 1] + delta * share, a[:, 2] + b[:, 2] + delta * delta * a[:, 0] * share])


def moments(df: DataFrame, cols: Sequence[str]) -> list[tuple[int, float | None, float]]:
    """(n, mean, sum of squared deviations) of each column, null and NaN cells left out."""
    cols = list(cols)
    if not cols:
        return []

    def add(batch: pa.RecordBatch, total: np.ndarray) -> np.ndarray:
        for x, mask in matrices(batch, len(cols)):
            n = mask.sum(axis=0)
            mean = x.sum(axis=0) / np.maximum(n, 1)
            off = (x - mean) * mask
            total = _joined(total, np.column_stack([n, mean, (off * off).sum(axis=0)]))
        return total

    def join(parts: np.ndarray) -> np.ndarray:
        out = parts[0]
        for part in parts[1:]:
            out = _joined(out, part)
        return out

    total = _per_column(_cells(df, cols), len(cols), 3, add, join)
    if total is None:
        return [(0, None, 0.0)] * len(cols)
    return [(int(n), float(mean) if n else None, float(m2)) for n, mean, m2 in total]
