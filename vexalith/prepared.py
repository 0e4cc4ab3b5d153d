"""Prepared statements, their cache, and batched inserts."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from typing import Any

from .database import Database, Result, bound
from .plans.ast import Insert, Parsed, Statement
from .plans.parser import parse


class PreparedStatement:
    """A statement with ``?`` for values, parsed once and bound many times."""

    def __init__(self, sql: str):
        self.sql = sql
        self.parsed: Parsed = parse(sql)

    @property
    def parameters(self) -> int:
        return self.parsed.parameters

    def bind(self, *values: Any) -> Statement:
        return bound(self.parsed, values)

    def execute(self, database: Database, *values: Any) -> Result:
        return database.run(self.bind(*values))


class StatementCache:
    """Prepared statements by their text, the least recently used dropped beyond ``size``."""

    def __init__(self, size: int = 256):
        self.size = size
        self._kept: OrderedDict[str, PreparedStatement] = OrderedDict()

    def get(self, sql: str) -> PreparedStatement:
        if sql not in self._kept:
            self._kept[sql] = PreparedStatement(sql)
        self._kept.move_to_end(sql)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return self._kept[sql]

    def __len__(self) -> int:
        return len(self._kept)

    def execute(self, database: Database, sql: str, *values: Any) -> Result:
        return self.get(sql).execute(database, *values)


class BatchInserter:
    """Collects rows and inserts them together: when ``size`` are there, at flush and at the end."""

    def __init__(self, database: Database, table: str, columns: Sequence[str], size: int = 1000):
        self.database, self.table, self.columns, self.size = database, table, tuple(columns), size
        self._rows: list[tuple] = []
        self.ids: list[int] = []

    def add(self, *values: Any) -> None:
        self._rows.append(values)
        if len(self._rows) >= self.size:
            self.flush()

    def flush(self) -> list[int]:
        rows, self._rows = self._rows, []
        if not rows:
            return []
        ids = self.database.run(Insert(self.table, self.columns, tuple(rows))).ids
        self.ids += ids
        return ids

    def __enter__(self) -> BatchInserter:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.flush()
