"""The Python client: typed methods on a database in the same process."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from .database import Database, Result
from .errors import ConnectionClosedError, QueryError, TableNotFoundError
from .plans.ast import Chain, Condition, Delete, Name, Update
from .types import KIND_OF, ROW_ID, Column

#: The columns' types by Python type, for metadata schemas.
BY_PYTHON = {str: "TEXT", int: "INTEGER", float: "FLOAT", bool: "BOOLEAN", bytes: "BLOB"}
EMBEDDING = "embedding"


@dataclass
class VectorResult:
    """One hit of a search."""

    id: int
    distance: float
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class TableSchema:
    name: str
    vector_dim: int
    columns: dict[str, str]


class Client:
    """A database with a current table. Use it in ``with``, or close it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self._database: Database | None = Database(spark, path)
        self._current: str | None = None

    @property
    def database(self) -> Database:
        if self._database is None:
            raise ConnectionClosedError("The client is closed")
        return self._database

    def _table(self, table: str | None) -> str:
        name = table or self._current
        if name is None:
            raise QueryError("No table: pass one, or choose one by use()")
        if name not in self.database.tables():
            raise TableNotFoundError(name)
        return name

    def create_table(self, name: str, vector_dim: int, metadata_schema: dict[str, Any] | None = None, if_not_exists: bool = True) -> Client:
        """Its first column is ``embedding``; metadata columns by Python type or by type name."""
        columns = [Column(EMBEDDING, "VECTOR", vector_dim)]
        for n, t in (metadata_schema or {}).items():
            kind = BY_PYTHON.get(t) if isinstance(t, type) else KIND_OF.get(str(t).upper())
            if kind is None or kind == "VECTOR":
                raise QueryError(f"Unknown type {t} of column {n}")
            columns.append(Column(n, kind))
        self.database.create_table(name, columns, if_not_exists)
        self._current = name
        return self

    def use(self, name: str) -> Client:
        self._current = self._table(name)
        return self

    def drop_table(self, name: str, if_exists: bool = True) -> None:
        self.database.execute(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")
        if self._current == name:
            self._current = None

    def list_tables(self) -> list[str]:
        return self.database.tables()

    def schema(self, table: str | None = None) -> TableSchema:
        name = self._table(table)
        v = self.database.catalog.version(name)
        vector = v.vector()
        return TableSchema(name, vector.dim if vector else 0, {c.name: c.kind for c in v.columns})

    def insert(self, vector: Sequence[float], metadata: dict[str, Any] | None = None, table: str | None = None) -> int:
        return self.database.insert_direct(self._table(table), vector, metadata)

    def insert_batch(self, vectors: Sequence[Sequence[float]], metadata_list: Sequence[dict[str, Any]] | None = None, table: str | None = None) -> list[int]:
        return self.database.insert_batch_direct(self._table(table), vectors, metadata_list)

    def search(self, query_vector: Sequence[float], k: int = 10, table: str | None = None, filter_: str | None = None, metric: str = "euclidean") -> list[VectorResult]:
        """The k nearest; filter_: conditions of the dialect, applied before the search."""
        found = self.database.search(self._table(table), query_vector, k, metric, filter_)
        out = []
        for r in found.collect():
            d = r.asDict()
            out.append(VectorResult(d.pop(ROW_ID, 0), d.pop("distance"), {n: v for n, v in d.items() if n != EMBEDDING}))
        return out

    def get(self, row_id: int, table: str | None = None) -> dict[str, Any] | None:
        return self.database.get(self._table(table), row_id)

    def _by_id(self, row_id: int) -> Chain:
        return Chain(Condition(Name(ROW_ID), "=", (row_id,)))

    def update(self, row_id: int, metadata: dict[str, Any], table: str | None = None) -> int:
        return self.database.run(Update(self._table(table), tuple(metadata.items()), self._by_id(row_id))).affected

    def delete(self, row_id: int, table: str | None = None) -> int:
        return self.database.run(Delete(self._table(table), self._by_id(row_id))).affected

    def delete_all(self, table: str | None = None) -> int:
        return self.database.run(Delete(self._table(table))).affected

    def raw_sql(self, sql: str, *parameters: Any) -> Result:
        return self.database.execute(sql, parameters)

    def close(self) -> None:
        self._database = None

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *error: Any) -> None:
        self.close()
