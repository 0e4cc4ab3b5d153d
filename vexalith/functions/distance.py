"""Distances between vectors, in double precision.

``euclidean`` is the sum of squared differences, ``cosine`` one minus the cosine (0 when either
vector has no length), ``dot`` the negative inner product. Between two columns they are built of
Spark's own functions; to one query vector they run in numpy on Arrow batches, several times as
fast as the interpreted higher-order functions. New metrics are added by ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def dot(a: Column, b: Column) -> Column:
    return -_pairs(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    product = _pairs(a, b, lambda x, y: x * y)
    norms = F.sqrt(_pairs(a, a, lambda x, y: x * y)) * F.sqrt(_pairs(b, b, lambda x, y: x * y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(1 - product / F.when(norms == 0, F.lit(1.0)).otherwise(norms))


def _euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x: rows, q: queries as rows; a row of the result for each of x."""
    if len(q) == 1:
        d = x - q[0]
        return np.einsum("ij,ij->i", d, d)[:, None]
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1), 0)


def _dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return -(x @ q.T)


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))
    return np.where(n == 0, 0.0, 1 - (x @ q.T) / np.where(n == 0, 1.0, n))


_METRICS: dict[str, tuple[Callable[[Column, Column], Column], Kernel]] = {
    "euclidean": (euclidean, _euclidean),
    "cosine": (cosine, _cosine),
    "dot": (dot, _dot),
}


def register(name: str, column: Callable[[Column, Column], Column], kernel: Kernel) -> None:
    """A metric of one's own: on two columns, and on numpy rows against query rows."""
    _METRICS[name] = (column, kernel)


def metric(name: str) -> tuple[Callable[[Column, Column], Column], Kernel]:
    if name not in _METRICS:
        raise QueryError(f"Unknown metric {name}; there are {', '.join(sorted(_METRICS))}")
    return _METRICS[name]


def between(name: str, a: Column, b: Column) -> Column:
    """The distance of two vector columns; NULL where either is NULL or their lengths differ."""
    return F.when(F.size(a) == F.size(b), metric(name)[0](a, b))


def rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of dim entries without nulls, the vectors in double precision)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    off = np.asarray(column.offsets).astype(np.int64)
    ok = np.asarray(column.is_valid()) & (np.diff(off) == dim)
    values = column.values
    if values.null_count:
        bad = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
        ok &= bad[off[1:]] == bad[off[:-1]]
    at = np.flatnonzero(ok)
    flat = values.to_numpy(zero_copy_only=False)
    if len(at) == n and len(flat) == n * dim:
        return at, flat.reshape(n, dim).astype(np.float64)
    return at, flat[off[:-1][at, None] + np.arange(dim)].astype(np.float64)


def to_query(name: str, vector: Column, query: Sequence[float]) -> Column:
    """The distance of a column to one vector; NULL for NULLs, other lengths and what is not a number."""
    kernel = metric(name)[1]
    q = np.array([list(query)], np.float64)
    if not np.isfinite(q).all() or not q.size:
        raise QueryError("The query vector must have entries, all of them finite")

    @F.arrow_udf("double")
    def distance(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in parts:
            at, x = rows_of(v, q.shape[1])
            out = np.full(len(v), np.nan)
            out[at] = kernel(x, q)[:, 0]
            yield pa.array(out, mask=np.isnan(out))

    return distance(vector)


def create_sql_functions(spark: SparkSession) -> None:
    """l2sq, cosine_distance and negative_dot for spark.sql, inlined by the optimizer."""
    a, b = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)"
    total = lambda u, v, e: f"aggregate(zip_with({u}, {v}, (x, y) -> {e}), 0D, (s, z) -> s + z)"
    product = f"{a} * {b}"
    norm = f"(sqrt({total('u', 'u', product)}) * sqrt({total('v', 'v', product)}))"
    for name, body in (
        ("l2sq", total("u", "v", f"({a} - {b}) * ({a} - {b})")),
        ("negative_dot", f"-{total('u', 'v', product)}"),
        ("cosine_distance", f"CASE WHEN {norm} = 0 THEN 0D ELSE 1 - {total('u', 'v', product)} / {norm} END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u ARRAY<FLOAT>, v ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
