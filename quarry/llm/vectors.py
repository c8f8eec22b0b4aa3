"""Integer vectors, which the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components are held within this size, so that sums of 512 products fit a long.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """Whether a vector is there and every component is a finite number."""
    c = F.col(vector)
    return c.isNotNull() & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))


def floored(vector: str, factor: int = 256) -> Column:
    """Every component as the integer floor(factor * x), worked out in double precision."""
    bound = F.lit(float(LARGEST))
    return F.transform(F.col(vector), lambda x: F.greatest(-bound, F.least(bound, F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one integer matrix; shorter rows end in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *column.value_lengths().to_pylist()])
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for i in range(len(column)):
        row = flat[ends[i] : ends[i + 1]][:width]
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b: in floating point where no sum passes 2 ** 53."""
    largest = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(a.shape[1], 1)
    if largest < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def widest(rows: DataFrame, vector: str) -> int:
    return rows.agg(F.max(F.size(vector))).head()[0] or 0
