"""Column types: spellings, Spark types, and literals cast to them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import DimensionMismatchError, QueryError

#: The spellings of each type.
SPELLINGS = {
    "TEXT": ("TEXT", "VARCHAR", "STRING", "CHAR"),
    "INTEGER": ("INTEGER", "INT", "BIGINT", "SMALLINT", "TINYINT"),
    "FLOAT": ("FLOAT", "REAL", "DOUBLE", "DECIMAL", "NUMERIC"),
    "BOOLEAN": ("BOOLEAN", "BOOL"),
    "BLOB": ("BLOB", "BINARY"),
    "VECTOR": ("VECTOR",),
}
KIND_OF = {s: kind for kind, all_ in SPELLINGS.items() for s in all_}
SPARK = {
    "TEXT": T.StringType(),
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BLOB": T.BinaryType(),
    "VECTOR": T.ArrayType(T.FloatType()),
}
ROW_ID = "_row_id"


@dataclass(frozen=True)
class Column:
    """One column of a table as it was declared."""

    name: str
    kind: str
    dim: int = 0
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False
    default: Any = None

    def field(self) -> T.StructField:
        meta = {"kind": self.kind, "dim": self.dim, "primary_key": self.primary_key, "not_null": self.not_null, "unique": self.unique}
        if self.default is not None:
            meta["default"] = self.default
        return T.StructField(self.name, SPARK[self.kind], True, meta)

    @staticmethod
    def of(field: T.StructField) -> Column:
        m = field.metadata
        return Column(field.name, m.get("kind") or kind_of(field.dataType), m.get("dim", 0), m.get("primary_key", False), m.get("not_null", False), m.get("unique", False), m.get("default"))


def kind_of(t: T.DataType) -> str:
    """The engine's type for a Spark type; nested types other than numeric arrays have none."""
    if isinstance(t, T.StringType):
        return "TEXT"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.BinaryType):
        return "BLOB"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return "VECTOR"
    return "OTHER"


def literal_kind(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "INTEGER"
    if isinstance(v, float):
        return "FLOAT"
    if isinstance(v, str):
        return "TEXT"
    if isinstance(v, (bytes, bytearray)):
        return "BLOB"
    return "VECTOR"


def fitted(column: Column, v: Any) -> Any:
    """A literal as a value of the column's type; what does not fit is an error."""
    have = literal_kind(v)
    if have == "NULL":
        return None
    if column.kind == "VECTOR" and have == "VECTOR":
        out = [float(x) for x in v]
        if column.dim and len(out) != column.dim:
            raise DimensionMismatchError(column.dim, len(out))
        return out
    if column.kind == have:
        return bytes(v) if have == "BLOB" else v
    if column.kind == "FLOAT" and have == "INTEGER":
        return float(v)
    if column.kind == "INTEGER" and have == "FLOAT" and math.isfinite(v) and v == int(v):
        return int(v)
    raise QueryError(f"Column '{column.name}' is {column.kind}, value {v!r} is {have}")
