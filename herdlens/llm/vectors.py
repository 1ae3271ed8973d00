"""Vectors of an Arrow list column as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(name: str) -> Column:
    """A column of vectors as arrays of doubles."""
    return F.col(name).cast("array<double>")


def matrices(lists: pa.Array):
    """``(rows, matrix)`` for each length of the usable vectors of a list column.

    A vector that is null, empty, or holds a null or a non-finite entry is left out.
    """
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    values = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        if not size:
            continue
        rows = np.flatnonzero(sizes == size)
        if len(rows) == len(sizes):
            matrix = values.reshape(-1, size)
        else:
            matrix = values[starts[rows][:, None] + np.arange(size)]
        usable = np.isfinite(matrix).all(axis=1)
        yield rows[usable], matrix[usable]
