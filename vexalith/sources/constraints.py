"""NOT NULL, UNIQUE and PRIMARY KEY, checked over live rows and within the change itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, DimensionMismatchError
from ..types import Column


def check(rows: DataFrame, columns: Iterable[Column], existing: DataFrame | None) -> None:
    """Raises if the rows break a constraint. A column ``id`` is given by the engine and exempt.

    Uniqueness is one aggregation of the new keys and one semi join with the old ones; NULL repeats
    freely in a UNIQUE column, and not at all in a PRIMARY KEY.
    """
    columns = list(columns)
    tests = []
    for c in columns:
        if (c.not_null or c.primary_key) and c.name != "id":
            tests.append((c, "null", F.max(F.col(f"`{c.name}`").isNull())))
        if c.kind == "VECTOR":
            x = F.col(f"`{c.name}`")
            tests.append((c, "dim", F.max(F.when(F.size(x) != c.dim, F.size(x)))))
            tests.append((c, "entry", F.max(F.exists(x, lambda e: e.isNull()))))
    if tests:
        found = rows.agg(*[t.alias(f"t{i}") for i, (_, _, t) in enumerate(tests)]).first()
        for i, (c, what, _) in enumerate(tests):
            if what == "null" and found[i]:
                raise ConstraintError(f"NULL in column '{c.name}', which is NOT NULL")
            if what == "entry" and found[i]:
                raise ConstraintError(f"A vector in column '{c.name}' has a NULL entry")
            if what == "dim" and found[i] is not None:
                raise DimensionMismatchError(c.dim, found[i])
    for c in columns:
        if (c.unique or c.primary_key) and c.name != "id":
            first = violations(rows, c.name, existing).limit(1).collect()
            if first:
                raise ConstraintError(f"UNIQUE constraint violation on column '{c.name}': value {first[0]['k']!r} already exists")


def violations(rows: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """(k): the values that are in the rows more than once, or in existing rows already; NULLs are not."""
    keys = rows.select(F.col(f"`{column}`").alias("k")).where("k is not null")
    bad = keys.groupBy("k").count().where("count > 1").select("k")
    if existing is not None:
        old = existing.select(F.col(f"`{column}`").alias("k"))
        bad = bad.unionByName(keys.join(old, "k", "left_semi"))
    return bad.distinct()
