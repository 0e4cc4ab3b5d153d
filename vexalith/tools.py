"""The tool set for agents: ten functions of plain values, by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from .client import Client
from .errors import EngineError, QueryError


class Tools:
    """Keeps the open client; every tool returns a dict, errors as {"error": message}."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.client: Client | None = None
        self.path: str | None = None

    def _open(self) -> Client:
        if self.client is None:
            raise QueryError("No database is open")
        return self.client

    def create_database(self, path: str | None = None) -> dict[str, Any]:
        self.client, self.path = Client(self.spark, path), path
        return {"path": path, "tables": self.client.list_tables()}

    def open_database(self, path: str) -> dict[str, Any]:
        return self.create_database(path)

    def create_table(self, name: str, vector_dim: int, metadata_schema: dict[str, str] | None = None) -> dict[str, Any]:
        self._open().create_table(name, vector_dim, metadata_schema)
        return {"table": name, "vector_dim": vector_dim}

    def insert_vector(self, vector: list[float], metadata: dict[str, Any] | None = None, table: str | None = None) -> dict[str, Any]:
        return {"id": self._open().insert(vector, metadata, table)}

    def batch_insert(self, vectors: list[list[float]], metadata_list: list[dict[str, Any]] | None = None, table: str | None = None) -> dict[str, Any]:
        ids = self._open().insert_batch(vectors, metadata_list, table)
        return {"ids": ids, "count": len(ids)}

    def search_similar(self, query_vector: list[float], k: int = 10, table: str | None = None, filter: str | None = None) -> dict[str, Any]:  # noqa: A002
        found = self._open().search(query_vector, k, table, filter)
        return {"results": [{"id": r.id, "distance": r.distance, "metadata": r.metadata} for r in found]}

    def execute_sql(self, sql: str) -> dict[str, Any]:
        r = self._open().raw_sql(sql)
        return {"kind": r.kind, "affected": r.affected, "ids": r.ids, "rows": [row.asDict(True) for row in r.rows()]}

    def list_tables(self) -> dict[str, Any]:
        return {"tables": self._open().list_tables()}

    def use_table(self, name: str) -> dict[str, Any]:
        self._open().use(name)
        return {"table": name}

    def status(self) -> dict[str, Any]:
        c = self.client
        return {"open": c is not None, "path": self.path, "tables": c.list_tables() if c else [], "current_table": c._current if c else None}

    def all(self) -> dict[str, Callable[..., dict[str, Any]]]:
        names = "create_database open_database create_table insert_vector batch_insert search_similar execute_sql list_tables use_table status".split()
        return {n: self._safe(getattr(self, n)) for n in names}

    @staticmethod
    def _safe(f: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
        def call(*args: Any, **named: Any) -> dict[str, Any]:
            try:
                return f(*args, **named)
            except (EngineError, ValueError) as e:
                return {"error": str(e)}

        return call
