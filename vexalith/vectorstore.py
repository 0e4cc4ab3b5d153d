"""A store of vectors without SQL: id and vector, any metric."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .errors import DimensionMismatchError, QueryError
from .operators import similarity
from .operators.index import IndexConfig, IVFIndex
from .plans.ast import Chain, Condition, Delete, Insert, Name, Update
from .sources.catalog import Version, checkpoint_folder
from .types import ROW_ID, Column

TABLE, VECTOR = "vectors", "vector"


class VectorStore:
    """Vectors of one dimension; with a path they persist, and ``open`` finds them again."""

    def __init__(self, spark: SparkSession, dimension: int, metric: str = "euclidean", path: str | None = None):
        if dimension < 1:
            raise QueryError("The dimension must be at least 1")
        self.database = Database(spark, path)
        self.metric = metric
        self._index: tuple[Version, IVFIndex] | None = None
        self.database.create_table(TABLE, [Column(VECTOR, "VECTOR", dimension)], if_not_exists=True)
        self.dimension = self._version().columns[0].dim
        if self.dimension != dimension:
            raise DimensionMismatchError(self.dimension, dimension)

    @classmethod
    def open(cls, spark: SparkSession, path: str, metric: str = "euclidean") -> VectorStore:
        v = Database(spark, path).catalog.version(TABLE)
        return cls(spark, v.columns[0].dim, metric, path)

    def _version(self):
        return self.database.catalog.version(TABLE)

    def frame(self) -> DataFrame:
        return self.database.frame(TABLE).withColumnRenamed(ROW_ID, "id")

    def insert(self, vector: Sequence[float]) -> int:
        return self.insert_batch([vector])[0]

    def insert_batch(self, vectors: Sequence[Sequence[float]]) -> list[int]:
        """All of them or, if one does not fit, none."""
        if not vectors:
            return []
        return self.database.run(Insert(TABLE, (VECTOR,), tuple((list(v),) for v in vectors))).ids

    def append(self, frame: DataFrame, column: str) -> int:
        """The vectors of a DataFrame column; their number."""
        return self.database.append(TABLE, frame.select(F.col(column).alias(VECTOR))).affected

    def query(self, vector: Sequence[float], k: int = 10) -> DataFrame:
        """(id, distance) of the k nearest, ascending, ties by id."""
        if len(vector) != self.dimension:
            raise DimensionMismatchError(self.dimension, len(vector))
        return similarity.nearest(self.frame(), VECTOR, vector, k, self.metric, tie="id").select("id", "distance")

    def query_with_probes(self, vector: Sequence[float], k: int = 10, n_probe: int = 8) -> DataFrame:
        """As query, by an inverted-list index of the current vectors; n_probe is the breadth.

        The index is stored (below the store's path, else in the checkpoint folder) at the first
        query after a change, and read by the others.
        """
        version = self._version()
        if self._index is None or self._index[0] != version:
            place = f"{self.database.catalog.path}/_index" if self.database.catalog.path else checkpoint_folder(self.database.spark)
            self._index = (version, IVFIndex.build(self.frame(), VECTOR, f"{place}/ivf-{uuid.uuid4().hex}", IndexConfig()))
        return self._index[1].search(vector, k, n_probe, self.metric, ["id"]).select("id", "distance")

    def get(self, id_: int) -> list[float] | None:
        got = self.database.get(TABLE, id_)
        return got[VECTOR] if got else None

    def _by_id(self, id_: int) -> Chain:
        return Chain(Condition(Name(ROW_ID), "=", (id_,)))

    def delete(self, id_: int) -> bool:
        return self.database.run(Delete(TABLE, self._by_id(id_))).affected > 0

    def update(self, id_: int, vector: Sequence[float]) -> bool:
        return self.database.run(Update(TABLE, ((VECTOR, list(vector)),), self._by_id(id_))).affected > 0

    def __len__(self) -> int:
        return self.frame().count()

    def is_empty(self) -> bool:
        return self.frame().isEmpty()

    def centroid(self) -> np.ndarray | None:
        """The mean of all vectors; None if there are none."""
        got = similarity.centroid(self.frame(), VECTOR).collect()
        return np.array(got[0]["centroid"]) if got and got[0]["centroid"] else None

    def sync(self) -> None:
        """Changes are durable when they return; there is nothing left to write."""
