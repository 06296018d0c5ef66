"""Integer vectors of an embeddings table, and what tasks make of their batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a size above this, once scaled, are refused: sums of their squares would leave the 64-bit integers.
MOST = 1 << 28


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and none of them is null, infinite or not a number."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def integer_vectors(df: DataFrame, vector_column: str, scale: int, **columns: Column) -> DataFrame:
    """The given columns and x, an array of longs, the floors of the scaled components; rows whose vector is unusable() are left out.

    Reading it fails where a scaled component is larger than MOST.
    """
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    size = F.raise_error(F.lit(f"a vector has a component beyond {MOST / scale:.0f}")).cast("long")
    whole = lambda c: F.when(F.abs(c) * scale <= MOST, F.floor(c * scale)).otherwise(size)
    return df.where(usable(vector)).select(*[c.alias(n) for n, c in columns.items()], F.transform(vector, whole).alias("x"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """An array column as a matrix of int64, one row a vector; all must have one length, that is `width` if given."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = width or (int(sizes[0]) if len(sizes) else 0)
    if (sizes != width).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sizes), width)
