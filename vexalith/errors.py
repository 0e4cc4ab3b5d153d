"""Errors of the engine. All derive from EngineError."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ParseError(EngineError):
    """The statement is not of the dialect; says at which character."""


class QueryError(EngineError):
    """The statement names something unknown or asks for something impossible."""


class TableNotFoundError(QueryError):
    def __init__(self, name: str):
        super().__init__(f"Table '{name}' not found")
        self.name = name


class DimensionMismatchError(QueryError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"Vector dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class ConstraintError(QueryError):
    """A UNIQUE, PRIMARY KEY or NOT NULL constraint is violated."""


class ConflictError(EngineError):
    """Another writer has changed the same table since the change began."""


class TransactionError(EngineError):
    """begin, commit or rollback out of order."""


class ConnectionClosedError(EngineError):
    """The client was closed."""
