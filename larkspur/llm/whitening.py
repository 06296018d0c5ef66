"""Whitening of embeddings: moments merged pair by pair, eigenvectors on the driver, and a second pass that verifies.

Every partition makes the count, the mean and the centred scatter of its vectors, and so do merges of two, by Chan's
formula, in a tree: no task and no driver ever holds more than a few of these, of a size that depends on the
dimension alone. Sums are exact besides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.storage import bounded, cut
from larkspur.llm.vectors import integer_vectors, matrix

#: About as many partial results meet in one task of a level of the tree.
FAN_IN = 8


@dataclass
class Moments:
    """Count, exact sums (where vectors are integers), mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Those of the rows of a matrix."""
        sums: list[int] = []
        if x.dtype.kind == "i":  # in two halves, so that no sum overflows
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [(int(h) << 32) + int(s) for h, s in zip(high, low)]
        mean = np.array([s / len(x) for s in sums]) if sums else x.mean(axis=0)
        away = x - mean
        return Moments(len(x), sums, mean, away.T @ away)

    def merged(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + apart * (other.n / n), scatter)

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n

    def packed(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tobytes(), "scatter": self.scatter.tobytes()}

    @staticmethod
    def unpacked(row: Row) -> Moments:
        mean = np.frombuffer(row["mean"], np.float64)
        return Moments(row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(row["scatter"], np.float64).reshape(len(mean), len(mean)))


_PACKED = "n long, sums array<string>, mean binary, scatter binary"


def _moments_of(change):
    """Moments of a task's vectors, change()d batch by batch, as one row; none for no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                part = Moments.of(change(matrix(batch.column(0), len(found.mean) if found and change is _same else None)))
                found = found.merged(part) if found else part
        if found:
            yield pa.RecordBatch.from_pylist([found.packed()], schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())]))

    return run


def _same(x: np.ndarray) -> np.ndarray:
    return x


def _merged(a: Moments, b: Moments) -> Moments:
    if len(a.mean) != len(b.mean):
        raise ValueError("vectors differ in length")
    return a.merged(b)


def moments(vectors: DataFrame, change=_same) -> Moments | None:
    """The moments of all vectors in column x, after `change` of each batch's matrix; None if there are none."""
    parts = bounded(vectors.select("x")).mapInArrow(_moments_of(change), _PACKED).rdd.map(lambda r: [Moments.unpacked(r)])
    depth = max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN_IN)))
    # lists of none or one, as partitions may have no vectors
    both = lambda a, b: [_merged(a[0], b[0])] if a and b else a or b
    found = parts.treeAggregate([], both, both, depth)
    return found[0] if found else None


@dataclass
class Whitening:
    """What vectors are fit to: n, exact sums, and for the first components their eigenvectors, eigenvalues and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray  # one a row
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Vectors, centred, on the components, in units of each one's deviation; not a number on a component without any."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - np.array([s / self.n for s in self.sums])) @ self.components.T / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """The whitening of the vectors in column x, each of which counts; None if there are none.

    identity_error is the largest entry of the whitened vectors' own covariance, less the identity, as a second pass over
    all of them finds it; components without variance are left out of it, and without any other it is None.
    """
    found = moments(distinct)
    if found is None:
        return None
    v = found.covariance()
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    # what rounding leaves of a component without variance is none
    values = np.where(values > len(v) * np.finfo(float).eps * max(trace, 0), values, 0.0)[:components]
    model = Whitening(found.n, found.sums, np.ascontiguousarray(vectors[:, :components].T), values, values / trace if trace > 0 else np.full(len(values), np.nan))
    varied = np.flatnonzero(values)
    if len(varied):
        again = moments(distinct, lambda x: model.projected(x)[:, varied]).covariance()
        model.identity_error = float(np.abs(again - np.eye(len(varied))).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n * x - sum) squared, for each vector."""
    most = max((max(n * int(m), -n * int(m)) + abs(s) for m, s in zip(np.abs(x).max(axis=0), sums)), default=0)
    if most * most * x.shape[1] < 1 << 63:
        away = n * x - np.array(sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - np.array(sums, dtype=object)
    return (away * away).sum(axis=1).tolist()


def _scored(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = matrix(batch.column(at), len(model.sums))
            k, rows = len(model.values), batch.num_rows
            again = pa.array(np.repeat(np.arange(rows), k))
            number = lambda values: pa.array(values, pa.float64(), from_pandas=True)  # noqa: E731 not a number is null
            made = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array([str(d) for d in _deviations(x, model.n, model.sums)] if rows else [], pa.string()).take(again),
                number(model.projected(x).reshape(-1)),
                number(np.tile(model.explained, rows)),
                pa.array([model.identity_error] * (rows * k), pa.float64()),
            ]
            kept = [c.take(again) for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*[n for n in batch.schema.names if n != "x"], *_RESULTS])

    return run


_RESULTS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row and each of the first components.

    Vectors are the floors of the scaled components. Those that are null or empty, or hold nulls or numbers that aren't finite, are left
    out. Each distinct vector counts once, in n and in all that is fit. deviation is the exact sum over dimensions of (n * x - sum)
    squared, as decimal(38, 0), null beyond that. Rows that repeat, share an id or have none all come back. There are no more
    components than dimensions; on one without variance, as all are for a single vector, whitened is null, and so are
    explained and identity_error if none has any. Vectors of different lengths, or with a component beyond a million, are refused
    with an error. Other columns are not used. An empty table gives an empty result.
    """
    rows = integer_vectors(df, vector_column, scale, vec_id=F.col(f"`{id_column}`"))
    distinct = cut(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    number = T.DecimalType(38, 0)
    kinds = zip(_RESULTS, (T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType()))
    schema = T.StructType([rows.schema["vec_id"], *[T.StructField(n, k) for n, k in kinds]])
    if model is None:
        out = df.sparkSession.createDataFrame([], schema)
    else:
        out = bounded(rows).mapInArrow(_scored(model), schema)
    return out.withColumn("deviation", F.col("deviation").try_cast(number))
