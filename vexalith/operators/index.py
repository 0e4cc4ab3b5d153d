"""Approximate search: inverted lists (IVF) and hash buckets (LSH). Judged by recall.

An index is built once and stored: the vectors, partitioned by their list or bucket, and one row that
says how queries find theirs. A search reads only the partitions it probes (partition pruning) and
computes exact distances there, once. Opened anew, an index costs one small read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import QueryError
from ..functions.distance import metric as metric_of
from ..functions.distance import rows_of
from .similarity import Best, _blocks, _usable, nearest

#: Vectors, about, that centroids are fitted on; lists at most.
SAMPLE, LISTS = 20_000, 4096
#: Files of a list or bucket, at most, that a task set writes: a hot one is not left to one task.
FILES = 8
CELL, ROW = "_cell", "_n"


@dataclass(frozen=True)
class IndexConfig:
    """n_lists 0: the square root of the table, at most LISTS. n_probe: lists that a search reads; 0: as
    many as hold the share ``recall`` of the ten nearest, found out on the sample that is fitted on."""

    n_lists: int = 0
    n_probe: int = 0
    recall: float = 0.95
    n_bits: int = 10
    n_tables: int = 8
    seed: int = 17


def _with_cell(df: DataFrame, column: str, dim: int, assign, type_: str) -> DataFrame:
    @F.arrow_udf(type_)
    def cell(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in parts:
            at, x = rows_of(v, dim)
            yield assign(len(v), at, x)

    # Nondeterministic, so that the test for NULL is not pushed below and the cell computed twice.
    return df.withColumn(CELL, cell.asNondeterministic()(F.col(column))).where(F.col(CELL).isNotNull())


def _dimension(df: DataFrame, column: str) -> int:
    first = df.select(F.size(column).alias("n")).where(f"`{column}` is not null").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None or first["n"] < 1:
        raise QueryError("There are no vectors to index")
    return first["n"]


def _store(rows: DataFrame, path: str) -> None:
    rows.repartition(F.col(CELL), F.spark_partition_id() % FILES).write.partitionBy(CELL).parquet(f"{path}/cells")


def probes_for(x: np.ndarray, c: np.ndarray, recall: float, queries: int = 256, k: int = 10) -> int:
    """Lists that the rows of x must probe for that share of their k nearest others."""
    q = x[:queries]
    d = (x * x).sum(1) - 2 * q @ x.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return 1
    order = ((c * c).sum(1) - 2 * q @ c.T).argsort(1).argsort(1)
    home = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    place = np.sort(np.take_along_axis(order, home[near], 1).ravel())
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


class _Stored:
    """An index below a path: its partitioned rows, and its parameters."""

    path: str
    spark: SparkSession
    dim: int

    def rows(self, cells: Sequence[int]) -> DataFrame:
        """The rows of these lists or buckets; the other partitions are not read."""
        return self.spark.read.parquet(f"{self.path}/cells").where(F.col(CELL).isin([int(c) for c in cells]))

    def _checked(self, query: Sequence[float]) -> np.ndarray:
        q = np.asarray(query, np.float64)
        if len(q) != self.dim:
            raise QueryError(f"Vector dimension mismatch: expected {self.dim}, got {len(q)}")
        return q


class IVFIndex(_Stored):
    """Vectors by their nearest of n_lists centroids; a search reads the n_probe nearest lists."""

    def __init__(self, spark: SparkSession, path: str, column: str, centroids: np.ndarray, n_probe: int):
        self.spark, self.path, self.column, self.centroids, self.n_probe = spark, path, column, centroids, n_probe
        self.dim = centroids.shape[1]

    @classmethod
    def build(cls, df: DataFrame, column: str, path: str, config: IndexConfig = IndexConfig()) -> IVFIndex:
        """Fits the centroids on about SAMPLE vectors and stores all of them by list."""
        spark, dim = df.sparkSession, _dimension(df, column)
        total = df.count()
        rows = df.select(F.col(column).cast("array<double>").alias("v")).where(F.size("v") == dim)
        if total > SAMPLE:
            rows = rows.sample(fraction=min(1.0, 1.1 * SAMPLE / total), seed=config.seed).limit(SAMPLE)
        x = np.array([r["v"] for r in rows.collect() if None not in r["v"]], np.float64).reshape(-1, dim)
        if not len(x):
            raise QueryError("There are no vectors to index")
        k = min(config.n_lists or min(LISTS, max(1, round(total**0.5))), len(x))
        rng = np.random.default_rng(config.seed)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            for j in np.unique(near):
                c[j] = x[near == j].mean(0)
        n_probe = config.n_probe or probes_for(x, c, config.recall)
        shared = spark.sparkContext.broadcast(c)

        def assign(n: int, at: np.ndarray, v: np.ndarray) -> pa.Array:
            cc = shared.value
            out, miss = np.zeros(n, np.int32), np.ones(n, bool)
            out[at] = ((cc * cc).sum(1) - 2 * v @ cc.T).argmin(1)
            miss[at] = False
            return pa.array(out, mask=miss)

        _store(_with_cell(df, column, dim, assign, "int"), path)
        meta = [(column, n_probe, n, [float(y) for y in row]) for n, row in enumerate(c)]
        spark.createDataFrame(meta, "column string, n_probe int, number int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path, column, c, n_probe)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IVFIndex:
        got = spark.read.parquet(f"{path}/centroids").orderBy("number").collect()
        return cls(spark, path, got[0]["column"], np.array([r["centroid"] for r in got]), got[0]["n_probe"])

    def _near(self, q: np.ndarray, n_probe: int | None) -> np.ndarray:
        """The lists nearest to each query."""
        d = (self.centroids * self.centroids).sum(1) - 2 * q @ self.centroids.T
        return d.argsort(1, kind="stable")[:, : n_probe or self.n_probe]

    def search(self, query: Sequence[float], k: int = 10, n_probe: int | None = None, metric: str = "euclidean", tie: Sequence[str] = ()) -> DataFrame:
        """The k nearest of the lists probed; more probes, more recall."""
        lists = self._near(self._checked(query)[None], n_probe)[0]
        return nearest(self.rows(lists).drop(CELL), self.column, query, k, metric, tie)

    def search_each(self, queries: DataFrame, query_id: str, query_column: str, base_id: str, k: int = 10, n_probe: int | None = None, metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
        """(query_id, neighbour_id, distance, rank) for every row of a query set, from its n_probe lists.

        Queries go out in blocks of bounded bytes; the lists are multiplied where they lie, and k
        rows a query and task are shuffled. Queries of another dimension find nothing.
        """
        kernel = metric_of(metric)[1]
        base = self.spark.read.parquet(f"{self.path}/cells")
        pa_q, pa_b = to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(base.schema[base_id].dataType)
        schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, neighbour_id {base.schema[base_id].dataType.simpleString()}, distance double"
        out = None
        for dim, names, qs in _blocks(_usable(queries, query_id, query_column)):
            if dim != self.dim:
                continue
            probes = self._near(qs, n_probe)
            shared = self.spark.sparkContext.broadcast((names, qs, probes))

            def find(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, qs, probes = shared.value
                order = np.argsort(probes.ravel(), kind="stable")
                lists, asking = probes.ravel()[order], order // probes.shape[1]
                best = Best(len(qs), k)
                for b in rows:
                    at, x = rows_of(b.column(1), qs.shape[1])
                    cell = b.column(2).to_numpy(zero_copy_only=False)[at]
                    ids = b.column(0).take(pa.array(at))
                    for c in np.unique(cell):
                        q = asking[np.searchsorted(lists, c) : np.searchsorted(lists, c, "right")]
                        mine = np.flatnonzero(cell == c)
                        if len(q):
                            here = ids.take(pa.array(mine)).to_pylist()
                            d = kernel(x[mine], qs[q]).T
                            if exclude_self:
                                for n, i in enumerate(q):
                                    d[n, [j for j, name in enumerate(here) if name == names[i]]] = np.inf
                            best.add(q, here, d)
                yield best.batch(names, pa_q, pa_b)

            one = self.rows(np.unique(probes)).where(F.col(base_id).isNotNull()).select(base_id, self.column, CELL).mapInArrow(find, schema)
            out = one if out is None else out.unionByName(one)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class LSHIndex(_Stored):
    """Vectors by the signs of n_bits projections, in n_tables tables; a search reads its buckets.

    A vector is stored once a table; what several buckets of a query hold counts once.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, dim: int, config: IndexConfig):
        self.spark, self.path, self.column, self.dim, self.config = spark, path, column, dim, config
        self.planes = np.random.default_rng(config.seed).standard_normal((dim, config.n_tables * config.n_bits))

    @classmethod
    def build(cls, df: DataFrame, column: str, path: str, config: IndexConfig = IndexConfig()) -> LSHIndex:
        index = cls(df.sparkSession, path, column, _dimension(df, column), config)
        planes, tables, bits = index.planes, config.n_tables, config.n_bits

        def assign(n: int, at: np.ndarray, v: np.ndarray) -> pa.Array:
            codes = _codes(v @ planes, tables, bits)
            counts = np.zeros(n, np.int32)
            counts[at] = tables
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            miss = np.ones(n, bool)
            miss[at] = False
            return pa.ListArray.from_arrays(pa.array(off, mask=np.append(miss, False)), pa.array(codes.ravel()))

        coded = _with_cell(df, column, index.dim, assign, "array<int>").withColumn(ROW, F.monotonically_increasing_id())
        _store(coded.withColumn(CELL, F.explode(CELL)), path)
        meta = [(column, index.dim, config.n_bits, config.n_tables, config.seed)]
        df.sparkSession.createDataFrame(meta, "column string, dim int, n_bits int, n_tables int, seed long").coalesce(1).write.parquet(f"{path}/planes")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LSHIndex:
        r = spark.read.parquet(f"{path}/planes").first()
        return cls(spark, path, r["column"], r["dim"], IndexConfig(n_bits=r["n_bits"], n_tables=r["n_tables"], seed=r["seed"]))

    def search(self, query: Sequence[float], k: int = 10, metric: str = "euclidean", tie: Sequence[str] = ()) -> DataFrame:
        """The k nearest among the rows that share a bucket with the query in any table."""
        codes = _codes(self._checked(query)[None] @ self.planes, self.config.n_tables, self.config.n_bits)[0]
        return nearest(self.rows(codes).drop(CELL).dropDuplicates([ROW]).drop(ROW), self.column, query, k, metric, tie)


def _codes(products: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of each row in each table, numbered over all tables."""
    on = (products > 0).reshape(len(products), tables, bits)
    return (on @ (1 << np.arange(bits)) + (np.arange(tables) << bits)).astype(np.int32)
