"""SELECT statements as DataFrames. Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, TableNotFoundError
from ..functions import aggregates, predicates
from ..operators.similarity import DEFAULT_K, nearest
from ..types import ROW_ID, kind_of, literal_kind
from .ast import Aggregate, Chain, Condition, Item, Name, Select

DISTANCE = "distance"
Tables = Callable[[str], DataFrame]


class Scope:
    """The columns that names of a statement can mean."""

    def __init__(self, df: DataFrame, tables: dict[str, dict[str, str]] | None = None):
        self.df = df
        #: table -> column -> name in df; None: one table, names as they are
        self.tables = tables
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def name(self, n: Name, table: str | None = None) -> str:
        if self.tables is None:
            if n.table is not None and table is not None and n.table != table:
                raise QueryError(f"Unknown table {n.table}")
            if n.column not in self.kinds:
                raise QueryError(f"Column '{n.column}' not found")
            return n.column
        if n.table is not None:
            match = [t for t in self.tables if t == n.table] or [t for t in self.tables if t.lower() == n.table.lower()]
            if not match:
                raise QueryError(f"Unknown table {n.table}")
            if n.column not in self.tables[match[0]]:
                raise QueryError(f"Column '{n}' not found")
            return self.tables[match[0]][n.column]
        found = [c[n.column] for c in self.tables.values() if n.column in c]
        if len(found) != 1:
            raise QueryError(f"Column '{n.column}' " + ("not found" if not found else "is in both tables"))
        return found[0]

    def resolve(self, n: Any) -> tuple[Column, str]:
        if isinstance(n, Aggregate):
            raise QueryError("An aggregate can stand in HAVING only")
        c = self.name(n)
        return F.col(f"`{c}`"), self.kinds[c]


def select(s: Select, tables: Tables) -> DataFrame:
    """The result of a SELECT. Filters come before SIMILARITY, DISTINCT before ORDER BY."""
    scope = joined(s, tables) if s.join else Scope(tables(s.table))
    where, query = split_similarity(s.where)
    df = scope.df
    if where is not None:
        df = df.where(predicates.chain(where, scope.resolve))
    grouped = bool(s.group_by) or any(isinstance(i.value, Aggregate) for i in s.items or ())
    if query is not None:
        if grouped or s.group_by:
            raise QueryError("SIMILARITY does not go with aggregates or GROUP BY")
        return similar(s, scope, df, query)
    if grouped:
        return ordered(groups(s, scope, df), s, None)
    items = star(s, scope) if s.items is None else [(scope.name(i.value, s.table), i.alias or output_name(i.value, scope)) for i in s.items]
    if s.distinct:
        out = df.select(*[F.col(f"`{c}`").alias(a) for c, a in items]).distinct()
        return ordered(out, s, None)
    return ordered(df, s, scope, items)


def output_name(n: Name, scope: Scope) -> str:
    return n.column if scope.tables is None else scope.name(n)


def star(s: Select, scope: Scope) -> list[tuple[str, str]]:
    hidden = {ROW_ID, *(f"{t}.{ROW_ID}" for t in (s.table, s.join.table if s.join else ""))}
    return [(c, c) for c in scope.df.columns if c not in hidden]


def ordered(df: DataFrame, s: Select, scope: Scope | None, items: list[tuple[str, str]] | None = None) -> DataFrame:
    """ORDER BY any column of the input (or of the output, by its alias), OFFSET, LIMIT, projection.

    NULLs come first ascending and last descending.
    """
    keys = []
    by_alias = {a: c for c, a in items or ()}
    for n, ascending in s.order_by:
        if scope is None:
            if n.column not in df.columns:
                raise QueryError(f"Column '{n}' not found in the result")
            c = n.column
        else:
            c = by_alias[n.column] if n.table is None and n.column in by_alias else scope.name(n, s.table)
        keys.append(F.col(f"`{c}`").asc_nulls_first() if ascending else F.col(f"`{c}`").desc_nulls_last())
    if keys:
        df = df.orderBy(*keys)
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in items]) if items else df


def groups(s: Select, scope: Scope, df: DataFrame) -> DataFrame:
    """GROUP BY, aggregates, HAVING by output names or aggregate expressions."""
    if s.items is None:
        raise QueryError("SELECT * does not go with GROUP BY")
    keys = [scope.name(g, s.table) for g in s.group_by]
    out: list[Column] = []
    names: list[tuple[str, str]] = []
    kinds: dict[str, str] = {}
    extra: dict[Aggregate, str] = {}

    def build(a: Aggregate) -> tuple[Column, str]:
        c = scope.name(a.argument, s.table) if a.argument else None
        kind = scope.kinds[c] if c else None
        return aggregates.aggregate(a.function, F.col(f"`{c}`") if c else None, kind), aggregates.RESULT_KIND.get(a.function) or kind or "OTHER"

    for i in s.items:
        if isinstance(i.value, Aggregate):
            label = i.alias or i.value.default_name()
            column, kinds[label] = build(i.value)
            extra.setdefault(i.value, label)
            out.append(column.alias(label))
            names.append((label, label))
        else:
            c = scope.name(i.value, s.table)
            if c not in keys:
                raise QueryError(f"Column '{i.value}' must be in GROUP BY or in an aggregate")
            label = i.alias or output_name(i.value, scope)
            kinds[label] = scope.kinds[c]
            names.append((c, label))
    if len({a for _, a in names}) < len(names):
        raise QueryError("Two output columns have the same name; give one an alias")
    shown = {a for _, a in names}
    for c in s.having.conditions() if s.having else ():
        if isinstance(c.left, Aggregate) and c.left not in extra:
            label = extra[c.left] = f"_having_{len(extra)}"
            column, kinds[label] = build(c.left)
            out.append(column.alias(label))
    if not out:
        out.append(F.count(F.lit(1)).alias("_rows"))
    renamed = {c: f"_key_{k}" for k, c in enumerate(keys)}
    grouped = df.select("*", *[F.col(f"`{c}`").alias(k) for c, k in renamed.items()]).groupBy(*renamed.values()).agg(*out)
    result = grouped.select(
        *[F.col(renamed.get(c, c) if a not in extra.values() else a).alias(a) for c, a in names], *[F.col(k).alias(f"_group_{k}") for k in renamed.values()], *[F.col(a) for a in extra.values() if a not in shown]
    )
    if s.having is not None:

        def resolve(n: Name | Aggregate) -> tuple[Column, str]:
            label = extra[n] if isinstance(n, Aggregate) else n.column
            if label in kinds:
                return F.col(f"`{label}`"), kinds[label]
            c = scope.name(n, s.table)
            if c in renamed:
                return F.col(f"_group_{renamed[c]}"), scope.kinds[c]
            raise QueryError(f"Column '{n}' in HAVING is neither an output nor a group column")

        result = result.where(having_chain(s.having, resolve))
    result = result.select(*[F.col(f"`{a}`") for _, a in names])
    return result.distinct() if s.distinct else result


def having_chain(chain: Chain, resolve) -> Column:
    """As WHERE, but equality of FLOAT results holds within 1e-10 and never for NULL."""

    def one(c: Condition) -> Column:
        column, kind = resolve(c.left)
        if c.operator in ("=", "!=") and kind == "FLOAT" and literal_kind(c.values[0]) in ("INTEGER", "FLOAT"):
            same = column.isNotNull() & (F.abs(column - F.lit(float(c.values[0]))) < 1e-10)
            return same if c.operator == "=" else ~same
        return predicates.condition(c, resolve)

    out = one(chain.first)
    for word, c in chain.rest:
        out = out & one(c) if word == "AND" else out | one(c)
    return out


def joined(s: Select, tables: Tables) -> Scope:
    """An equi-join of two tables. NULL keys meet; numbers join numbers of the other kind."""
    j = s.join
    assert j is not None
    if j.table == s.table:
        raise QueryError("A table cannot be joined with itself here: there are no table aliases")
    left, right = tables(s.table), tables(j.table)
    mine = {c: f"{s.table}.{c}" for c in left.columns}
    other = {c: f"{j.table}.{c}" for c in right.columns}
    a = left.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()])
    b = right.select(*[F.col(f"`{c}`").alias(n) for c, n in other.items()])
    kinds = {n: kind_of(f.dataType) for d in (a, b) for n, f in ((f.name, f) for f in d.schema.fields)}

    def side(n: Name) -> str:
        if n.table is None:
            raise QueryError("ON needs columns with their tables")
        for table, columns in ((s.table, mine), (j.table, other)):
            if n.table.lower() == table.lower():
                if n.column not in columns:
                    raise QueryError(f"Column '{n}' not found")
                return columns[n.column]
        raise QueryError(f"Unknown table {n.table}")

    x, y = side(j.left), side(j.right)
    if (x in mine.values()) == (y in mine.values()):
        raise QueryError("ON needs a column of either table")
    if y in mine.values():
        x, y = y, x
    number = {"INTEGER", "FLOAT"}
    if kinds[x] != kinds[y] and not {kinds[x], kinds[y]} <= number:
        on = F.lit(False)
    elif kinds[x] != kinds[y]:
        on = a[f"`{x}`"].cast("double").eqNullSafe(b[f"`{y}`"].cast("double"))
    else:
        on = a[f"`{x}`"].eqNullSafe(b[f"`{y}`"])
    return Scope(a.join(b, on, j.kind.lower()), {s.table: mine, j.table: other})


def split_similarity(where: Chain | None) -> tuple[Chain | None, Condition | None]:
    """(the other conditions, the SIMILARITY condition). It is joined to the others by AND."""
    if where is None:
        return None, None
    hits = [c for c in where.conditions() if c.operator == "SIMILARITY"]
    if not hits:
        return where, None
    if len(hits) > 1:
        raise QueryError("A statement takes one SIMILARITY condition")
    if any(word == "OR" for word, _ in where.rest):
        raise QueryError("SIMILARITY goes with AND only")
    if literal_kind(hits[0].values[0]) != "VECTOR":
        raise QueryError("SIMILARITY needs a vector")
    others = [c for c in where.conditions() if c.operator != "SIMILARITY"]
    return (Chain(others[0], tuple(("AND", c) for c in others[1:])) if others else None), hits[0]


def similar(s: Select, scope: Scope, df: DataFrame, query: Condition) -> DataFrame:
    """Filter first, then the nearest k = LIMIT (or 10) by squared Euclidean distance."""
    assert isinstance(query.left, Name)
    column = scope.name(query.left, s.table)
    k = (DEFAULT_K if s.limit is None else s.limit) + (s.offset or 0)
    ties = [c for c in df.columns if c == ROW_ID or c.endswith(f".{ROW_ID}")]
    out = nearest(df, column, query.values[0], k, tie=ties)
    if s.order_by:
        out = ordered(out, Select(s.table, None, order_by=s.order_by), Scope(out, scope.tables))
    if s.offset:
        out = out.offset(s.offset)
    items = [c for c, _ in star(s, scope)] if s.items is None else [scope.name(i.value, s.table) for i in s.items if isinstance(i.value, Name)]
    names = items if s.items is None else [i.alias or output_name(i.value, scope) for i in s.items if isinstance(i.value, Name)]
    out = out.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(items, names)], DISTANCE)
    return out.distinct() if s.distinct else out


__all__ = ["Item", "Scope", "TableNotFoundError", "select"]
