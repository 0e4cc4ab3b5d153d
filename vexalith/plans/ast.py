"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..types import Column


@dataclass(frozen=True)
class Parameter:
    """A ``?``; number counts from 0."""

    number: int


@dataclass(frozen=True)
class Name:
    """A column, maybe with its table."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Aggregate:
    """COUNT, SUM, AVG, MIN or MAX of a column; None counts rows."""

    function: str
    argument: Name | None

    def default_name(self) -> str:
        return f"{self.function.lower()}_{self.argument.column}" if self.argument else "count"


@dataclass(frozen=True)
class Item:
    """One output column."""

    value: Name | Aggregate
    alias: str | None = None


@dataclass(frozen=True)
class Condition:
    """column operator values; the operators are those of ``predicates.OPERATORS``."""

    left: Name | Aggregate
    operator: str
    values: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Chain:
    """Conditions combined from left to right: first, then (AND or OR, condition) pairs."""

    first: Condition
    rest: tuple[tuple[str, Condition], ...] = ()

    def conditions(self) -> list[Condition]:
        return [self.first, *(c for _, c in self.rest)]


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    left: Name
    right: Name


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[Item, ...] | None
    distinct: bool = False
    join: Join | None = None
    where: Chain | None = None
    group_by: tuple[Name, ...] = ()
    having: Chain | None = None
    order_by: tuple[tuple[Name, bool], ...] = ()
    limit: Any = None
    offset: Any = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    values: tuple[tuple[str, Any], ...]
    where: Chain | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Chain | None = None


@dataclass(frozen=True)
class ShowTables:
    pass


Statement = Select | CreateTable | DropTable | Insert | Update | Delete | ShowTables


@dataclass
class Parsed:
    statement: Statement
    parameters: int = field(default=0)
