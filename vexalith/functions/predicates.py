"""Predicates with two-valued NULL logic.

NULL equals NULL; a comparison that cannot be made is false and its negation true; values of
different kinds (numbers among each other excepted) are never equal and have no order. Conditions
are written with null-safe equality and null tests, which reach the Parquet scan as filters, not
with coalesce, which does not.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.ast import Chain, Condition
from ..types import literal_kind

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "LIKE", "NOT LIKE", "IN", "NOT IN", "BETWEEN", "NOT BETWEEN", "IS NULL", "IS NOT NULL", "SIMILARITY")
_NUMERIC = ("INTEGER", "FLOAT")
Resolve = Callable[[Any], tuple[Column, str]]


def comparable(kind: str, v: Any) -> bool:
    have = literal_kind(v)
    return (kind in _NUMERIC and have in _NUMERIC) or (kind == have and kind in ("TEXT", "BOOLEAN", "BLOB"))


def equals(c: Column, kind: str, v: Any) -> Column:
    if v is None:
        return c.isNull()
    return c.eqNullSafe(F.lit(v)) if comparable(kind, v) else F.lit(False)


def ordered(c: Column, kind: str, v: Any, test: Callable[[Column, Column], Column]) -> Column:
    """False where there is no order: NULL, booleans, vectors, values of other kinds."""
    if v is None or kind not in (*_NUMERIC, "TEXT") or not comparable(kind, v):
        return F.lit(False)
    return c.isNotNull() & test(c, F.lit(v))


def like(c: Column, kind: str, pattern: Any) -> Column:
    """In any case of letters; % and _ everywhere in the pattern; text only."""
    if kind != "TEXT" or not isinstance(pattern, str):
        return F.lit(False)
    escaped = pattern.replace("\\", "\\\\")
    return c.isNotNull() & c.ilike(escaped)


def between(c: Column, kind: str, low: Any, high: Any) -> Column:
    return ordered(c, kind, low, lambda a, b: a >= b) & ordered(c, kind, high, lambda a, b: a <= b)


def condition(x: Condition, resolve: Resolve) -> Column:
    c, kind = resolve(x.left)
    v = x.values
    if x.operator == "=":
        return equals(c, kind, v[0])
    if x.operator == "!=":
        return ~equals(c, kind, v[0])
    if x.operator == "<":
        return ordered(c, kind, v[0], lambda a, b: a < b)
    if x.operator == "<=":
        return ordered(c, kind, v[0], lambda a, b: a <= b)
    if x.operator == ">":
        return ordered(c, kind, v[0], lambda a, b: a > b)
    if x.operator == ">=":
        return ordered(c, kind, v[0], lambda a, b: a >= b)
    if x.operator in ("IN", "NOT IN"):
        fits = [w for w in v if w is not None and comparable(kind, w)]
        found = (c.isNotNull() & c.isin(fits)) if fits else F.lit(False)
        if any(w is None for w in v):
            found = found | c.isNull()
        return found if x.operator == "IN" else ~found
    if x.operator == "LIKE":
        return like(c, kind, v[0])
    if x.operator == "NOT LIKE":
        return ~like(c, kind, v[0])
    if x.operator == "BETWEEN":
        return between(c, kind, *v)
    if x.operator == "NOT BETWEEN":
        return ~between(c, kind, *v)
    if x.operator == "IS NULL":
        return c.isNull()
    if x.operator == "IS NOT NULL":
        return c.isNotNull()
    raise QueryError(f"{x.operator} is not possible here")


def chain(x: Chain, resolve: Resolve) -> Column:
    """AND and OR bind alike and go from left to right."""
    out = condition(x.first, resolve)
    for word, c in x.rest:
        out = out & condition(c, resolve) if word == "AND" else out | condition(c, resolve)
    return out
