"""Similarity search: exact nearest neighbours of one vector, of many, per group.

Exact search is the default plan. One query vector: distances on Arrow batches, then a top-k that
every task does for itself first (TakeOrderedAndProject). Many query vectors: they go out in blocks
of bounded bytes; a task multiplies its rows with the block and keeps k candidates a query, so what
is shuffled is k rows a query and task, whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import DimensionMismatchError, QueryError
from ..functions import distance as D

#: Bytes of query vectors sent to the tasks at once.
QUERY_BYTES = 16 << 20
#: Rows that a task multiplies with a block of queries at once; distances it gives out at once.
ROWS, PAIRS = 1024, 1 << 18
DEFAULT_K = 10


def check_dimension(df: DataFrame, column: str, query: Sequence[float]) -> None:
    if column not in df.columns:
        raise QueryError(f"Column '{column}' not found")
    dim = df.schema[column].metadata.get("dim")
    if dim and dim != len(query):
        raise DimensionMismatchError(dim, len(query))


def nearest(df: DataFrame, column: str, query: Sequence[float], k: int = DEFAULT_K, metric: str = "euclidean", tie: str | Sequence[str] = (), name: str = "distance") -> DataFrame:
    """The k rows nearest to a vector with their distance, ascending; ties by the columns of tie.

    Rows whose vector is null, of another length or without a finite distance are left out. Filter
    df first to search within a part of it.
    """
    check_dimension(df, column, query)
    if k < 0:
        raise QueryError("k must not be negative")
    if name in df.columns:
        raise QueryError(f"There is a column '{name}' already; give the distance another name")
    ties = [tie] if isinstance(tie, str) else list(tie)
    # Rows without a distance go last and are dropped after the limit: a filter below it would be
    # pushed under the projection, and the distance computed twice.
    d = df.withColumn(name, D.to_query(metric, F.col(column), query))
    return d.orderBy(F.col(name).asc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]).limit(k).where(F.col(name).isNotNull())


def nearest_per_group(df: DataFrame, column: str, query: Sequence[float], group: str, k: int, metric: str = "euclidean", tie: Sequence[str] = (), name: str = "distance") -> DataFrame:
    """The k nearest rows of every group. Tasks keep their own k of each group before the shuffle."""
    check_dimension(df, column, query)
    d = df.withColumn(name, D.to_query(metric, F.col(column), query))
    # Spark's window group limit ranks within each task first, so a large group is cut before it moves.
    w = Window.partitionBy(group).orderBy(F.col(name).asc_nulls_last(), *[F.col(t).asc_nulls_first() for t in tie])
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col(name).isNotNull())


def _usable(queries: DataFrame, id_: str, column: str) -> DataFrame:
    return queries.select(F.col(id_).alias("q"), F.col(column).cast("array<double>").alias("v")).where("q is not null and v is not null and size(v) > 0")


def _blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[tuple[int, list, np.ndarray]]:
    """(dimension, ids, vectors) of at most ``most`` bytes each, read from the query set part by part."""
    held: dict[int, tuple[list, list]] = {}
    for r in queries.toLocalIterator(prefetchPartitions=True):
        if None in r["v"]:
            continue
        ids, rows = held.setdefault(len(r["v"]), ([], []))
        ids.append(r["q"])
        rows.append(np.array(r["v"], np.float64))
        if len(rows) * len(r["v"]) * 8 >= most:
            yield len(r["v"]), ids, np.stack(rows)
            del held[len(r["v"])]
    for dim, (ids, rows) in held.items():
        yield dim, ids, np.stack(rows)


def _over_blocks(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, query_column: str, base_column: str, schema: str, task) -> DataFrame:
    """The union over the blocks of queries of one pass over base each. task: (rows, dim, query ids, queries) -> batches."""
    spark = base.sparkSession
    out: DataFrame | None = None
    source = base.select(base_id, base_column).where(F.col(base_id).isNotNull())
    for dim, ids, q in _blocks(_usable(queries, query_id, query_column)):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(rows: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            yield from task(rows, dim, *shared.value)

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


class Best:
    """The k least distances of each of n queries, with the ids they belong to; ties go to the less id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d, self.i = np.full((n, k), np.inf), np.full((n, k), -1)
        self.ids: list = []

    def add(self, q: np.ndarray, ids: list, d: np.ndarray) -> None:
        """d: distances of queries q (rows) to the ids (columns); what is not finite does not count."""
        d = np.where(np.isfinite(d), d, np.inf)
        limit = self.d[q, -1]
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, 1)[:, self.k - 1])
        r, c = np.nonzero((d <= limit[:, None]) & (d < np.inf))
        if not len(r):
            return
        met = np.unique(r)
        old_r, old_c = np.nonzero(self.i[q[met]] >= 0)
        rows = np.concatenate([met[old_r], r])
        dist = np.concatenate([self.d[q[met]][old_r, old_c], d[r, c]])
        at = np.concatenate([self.i[q[met]][old_r, old_c], len(self.ids) + c])
        self.ids += ids
        seen, of = np.unique(at, return_inverse=True)
        by_id = np.argsort(np.argsort(np.array([self.ids[i] for i in seen]), kind="stable"))
        order = np.lexsort((by_id[of], dist, rows))
        rows, dist, at = rows[order], dist[order], at[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.d[q[met]], self.i[q[met]] = np.inf, -1
        self.d[q[rows[keep]], place[keep]], self.i[q[rows[keep]], place[keep]] = dist[keep], at[keep]
        if len(self.ids) > 4 * max(ROWS, self.i.size):
            used, of = np.unique(self.i[self.i >= 0], return_inverse=True)
            self.i[self.i >= 0] = of
            self.ids = [self.ids[i] for i in used]

    def batch(self, names: list, query_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        r, c = np.nonzero(self.i >= 0)
        columns = [pa.array([names[n] for n in r], query_type), pa.array([self.ids[i] for i in self.i[r, c]], id_type), pa.array(self.d[r, c])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "neighbour_id", "distance"])


def nearest_for_each(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, query_column: str, base_column: str, k: int = DEFAULT_K, metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): k nearest rows of base for every row of a query set.

    Ties go to the less id; rows without an id, a vector or a finite distance are left out. The query
    set is gone through in blocks of QUERY_BYTES, each against all of base in one pass; a task keeps k
    candidates a query, so k rows a query and task are shuffled. For every row of a large table
    against all others use an index.
    """
    if k < 1:
        raise QueryError("k must be at least 1")
    kernel = D.metric(metric)[1]
    pa_q, pa_b = to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(base.schema[base_id].dataType)
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, neighbour_id {base.schema[base_id].dataType.simpleString()}, distance double"

    def search(rows: Iterator[pa.RecordBatch], dim: int, names: list, qs: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = Best(len(qs), k)
        own: dict = {}
        for n, q in enumerate(names if exclude_self else ()):
            own.setdefault(q, []).append(n)
        for b in rows:
            at, x = D.rows_of(b.column(1), dim)
            for lo in range(0, len(at), ROWS):
                here = b.column(0).take(pa.array(at[lo : lo + ROWS])).to_pylist()
                d = kernel(x[lo : lo + ROWS], qs).T
                for j, i in enumerate(here if exclude_self else ()):
                    d[own.get(i, []), j] = np.inf
                best.add(np.arange(len(qs)), here, d)
        yield best.batch(names, pa_q, pa_b)

    out = _over_blocks(queries, base, query_id, base_id, query_column, base_column, schema, search)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroid(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., centroid): the mean of every dimension, entry by entry, of all or of each group.

    Tasks add up whole vectors; what is shuffled is one array of sums a group and batch.
    """
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    schema = (keys + ", " if keys else "") + "sums array<double>, counts array<bigint>"

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            code = np.zeros(b.num_rows, np.int64)
            for n in range(len(by)):
                one = b.column(n).dictionary_encode()
                code = np.unique(code * (len(one.dictionary) + 1) + one.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1, return_inverse=True)[1]
            v = b.column(len(by))
            off = np.asarray(v.offsets).astype(np.int64)
            width = np.where(np.asarray(v.is_valid()), np.diff(off), 0)
            most = int(width.max()) if len(width) else 0
            flat = v.values.cast(pa.float64())
            there = np.asarray(flat.is_valid())
            flat = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            groups, first = np.unique(code, return_index=True)
            sums, counts = np.zeros((len(groups), most)), np.zeros((len(groups), most), np.int64)
            for w in np.unique(width[width > 0]):
                at = np.flatnonzero(width == w)
                cell = off[:-1][at, None] + np.arange(w)
                np.add.at(sums[:, :w], code[at], flat[cell])
                np.add.at(counts[:, :w], code[at], there[cell])
            ends = pa.array(np.arange(len(groups) + 1, dtype=np.int32) * most)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (sums, counts)]
            yield pa.RecordBatch.from_arrays([b.column(n).take(pa.array(first)) for n in range(len(by))] + lists, names=[*by, "sums", "counts"])

    partial = df.select(*by, column).mapInArrow(add, schema).select(*by, F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "x"))
    mean = partial.groupBy(*by, "pos").agg((F.sum("x.sums") / F.nullif(F.sum("x.counts"), F.lit(0))).alias("mean"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def distance_matrix(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_column: str, right_column: str, metric: str = "euclidean") -> DataFrame:
    """(left_id, right_id, distance) for a stated set of left vectors against all right ones.

    Each block of left vectors is multiplied with the right rows where they lie; nothing is shuffled.
    """
    kernel = D.metric(metric)[1]
    pa_l, pa_r = to_arrow_type(left.schema[left_id].dataType), to_arrow_type(right.schema[right_id].dataType)
    schema = f"left_id {left.schema[left_id].dataType.simpleString()}, right_id {right.schema[right_id].dataType.simpleString()}, distance double"

    def product(rows: Iterator[pa.RecordBatch], dim: int, names: list, qs: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(names, pa_l)
        for b in rows:
            at, x = D.rows_of(b.column(1), dim)
            step = max(1, PAIRS // len(qs))
            for lo in range(0, len(at), step):
                d = kernel(x[lo : lo + step], qs)
                r, c = np.nonzero(np.isfinite(d))
                ids = b.column(0).take(pa.array(at[lo : lo + step][r])).cast(pa_r)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), ids, pa.array(d[r, c])], names=["left_id", "right_id", "distance"])

    return _over_blocks(left, right, left_id, right_id, left_column, right_column, schema, product)
